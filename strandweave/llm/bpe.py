"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token BPE's own encoding ends in exactly one token. It is the token that matches a suffix of
the prefix (all matches come from an Aho-Corasick automaton, which walks the vocabulary's suffix links) and is compatible
with the last token of the prefix before it. Two tokens are compatible when undoing their merges, latest first, never
meets a merge across their border that BPE would have done earlier. Following the last tokens back gives the exact ids.

Normalising, splitting and merging never look across ASCII white space with this kind of tokenizer (white space is
dropped), so a word's ids are kept in a bounded cache and texts of any length pass through in stretches.

Null texts count as empty: no tokens, and the hashes of the empty string. Repeated rows are encoded each; extra columns
of the input are not carried by `digests`, and `encode` puts its columns after them.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import text, vocab
from strandweave.session import ship

#: Added to the code point of a pre-token's last symbol, so that symbols with and without a word end differ.
END = 0x4000
WORDS, PAIRS = 200_000, 500_000
_made: dict[str, WordBpe] = text.stores.setdefault("bpe", {})


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where printable, else the next code points from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(extra)) for b in range(256)]


class WordBpe:
    """A tokenizer of the word-end kind: NFC, lower case, split by a pattern, byte symbols, BPE with an end-of-word mark."""

    def __init__(self, source: bytes):
        import ahocorasick
        import regex

        spec = json.loads(source)
        model = spec["model"]
        ids, mark = model["vocab"], model["end_of_word_suffix"]
        self.symbols = byte_symbols()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        # Ranks order tokens as BPE makes them: symbols first, then merges.
        self.name, self.id_of, self.strings = [], [], []
        rank: dict[str, int] = {}
        for s in self.symbols:
            for key, string in ((s, s), (s + mark, chr(ord(s) + END))):
                rank[key] = len(self.name)
                self.name.append(key)
                self.id_of.append(ids[key])
                self.strings.append(string)
        self.base = len(self.name)
        self.parts, self.merged = [(i, i) for i in range(self.base)], {}
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = rank[left], rank[right]
            key = left + right
            if key not in rank:
                rank[key] = len(self.name)
                self.name.append(key)
                self.id_of.append(ids[key])
                self.strings.append(self.strings[pair[0]] + self.strings[pair[1]])
                self.parts.append(pair)
            self.merged.setdefault(pair, rank[key])
        self.found = ahocorasick.Automaton()
        for t, s in enumerate(self.strings):
            self.found.add_word(s, (t, len(s)))
        self.found.make_automaton()
        self.whole: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}
        self.words, self.tokens = vocab.Memo(WORDS), vocab.Memo(WORDS)

    def compatible(self, left: int, right: int) -> bool:
        """BPE keeps the border between these tokens."""
        before, merged, parts, base = len(self.name) + 1, self.merged, self.parts, self.base
        while True:
            joined = merged.get((left, right))
            if joined is not None and joined < before:
                return False
            # Undo the later of the two last merges; at equal rank BPE merged the left one first.
            if left > right and left >= base or right < base <= left:
                before, left = left, parts[left][1]
            elif right >= base:
                before, right = right + 1, parts[right][0]
            else:
                return True

    def stands(self, token: int) -> bool:
        """BPE gives this very token for its string."""
        ok = self.whole.get(token)
        if ok is None:
            left, right = self.parts[token]
            ok = token < self.base or (self.stands(left) and self.stands(right) and self.merged.get((left, right)) == token and self._only(token))
            self.whole[token] = ok
        return ok

    def _only(self, token: int) -> bool:
        return self._merge(self.strings[token]) == [token]

    def _merge(self, string: str) -> list[int]:
        """Plain BPE, used to test whole tokens."""
        one = {s: t for t, s in enumerate(self.strings[: self.base])}
        seq = [one[c] for c in string]
        while True:
            best = min(((m, i) for i in range(len(seq) - 1) if (m := self.merged.get((seq[i], seq[i + 1]))) is not None), default=None)
            if best is None:
                return seq
            seq[best[1] : best[1] + 2] = [best[0]]

    def pretoken(self, string: str) -> list[int]:
        """Ranks of the tokens of one pre-token, written in symbols."""
        n = len(string)
        last = [-1] * (n + 1)
        fits = self.fits
        for end, (token, size) in self.found.iter(string):
            i = end + 1
            if last[i] >= 0:
                continue
            if size == i:
                if self.stands(token):
                    last[i] = token
                continue
            before = last[i - size]
            pair = before << 20 | token
            ok = fits.get(pair)
            if ok is None:
                if len(fits) >= PAIRS:
                    fits.clear()
                ok = fits[pair] = self.compatible(before, token) and self.stands(token)
            if ok:
                last[i] = token
        out, i = [], n
        while i:
            out.append(last[i])
            i -= len(self.strings[last[i]])
        return out[::-1]

    def word(self, raw: bytes) -> tuple[int, bytes, bytes]:
        """(number of tokens, decimal ids, token strings) of a stretch without ASCII white space."""
        text_ = raw.decode("utf-8", "replace")
        parts: list[tuple[int, bytes, bytes]] = []
        at = 0
        for m in self.special.finditer(text_) if self.special and "<" in text_ else ():
            parts += self._plain(text_[at : m.start()])
            parts.append((1, b"%d" % self.specials[m[0]], m[0].encode()))
            at = m.end()
        parts += self._plain(text_[at:])
        if len(parts) == 1:
            return parts[0]
        return sum([p[0] for p in parts]), b" ".join([p[1] for p in parts]), b" ".join([p[2] for p in parts])

    def _plain(self, text_: str) -> list[tuple[int, bytes, bytes]]:
        if not text_.isascii():
            text_ = unicodedata.normalize("NFC", text_)
            text_ = "".join([c.lower() for c in text_])
        else:
            text_ = text_.lower()
        out = []
        tokens = self.pattern.findall(text_)
        for token in tokens:
            known = self.tokens.get(token)
            if known is None:
                s = "".join([self.symbols[b] for b in token.encode()])
                ranks = self.pretoken(s[:-1] + chr(ord(s[-1]) + END))
                known = len(ranks), " ".join([str(self.id_of[r]) for r in ranks]).encode(), " ".join([self.name[r] for r in ranks]).encode()
                if len(tokens) > 1:  # a word of one pre-token is kept as a word
                    self.tokens.put(token, known)
            out.append(known)
        return out

    def document(self, data: bytes) -> tuple[int, bytes, str]:
        """(number of tokens, all decimal ids, SHA-256 of the decoded text)."""
        n, ids, decoded = 0, [], hashlib.sha256()
        words, joint = self.words, b""
        for stretch in vocab.stretches(data):
            split = stretch.split()
            found = list(map(words.young.get, split))
            if None in found:
                for i, e in enumerate(found):
                    if e is None:
                        e = words.get(split[i])
                        if e is None:
                            e = self.word(split[i])
                            words.put(split[i], e)
                        found[i] = e
            found = [e for e in found if e[0]]
            if found:
                n += sum([e[0] for e in found])
                ids.append(b" ".join([e[1] for e in found]))
                decoded.update(joint + b" ".join([e[2] for e in found]))
                joint = b" "
        return n, b" ".join(ids), decoded.hexdigest()


def tokenizer(source: bytes) -> WordBpe:
    """One tokenizer a worker process and file."""
    key = hashlib.sha256(source).hexdigest()
    if key not in _made:
        _made[key] = WordBpe(source)
    return _made[key]


def _mapper(source, with_ids: bool, carry: list[str], names: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        t = tokenizer(source.value)
        for batch in batches:
            for part in text.pieces(batch, "_text", 4 << 20):
                n, sha, decoded, ids = [], [], [], []
                for data in part.column("_text").cast(pa.binary()):
                    count, decimal, hexed = t.document(data.as_py() or b"")
                    n.append(count)
                    sha.append(hashlib.sha256(decimal).hexdigest())
                    decoded.append(hexed)
                    if with_ids:
                        ids.append(np.array(decimal.split(), dtype=np.int32))
                columns = [part.column(c) for c in carry] + [pa.array(n, pa.int64()), pa.array(sha), pa.array(decoded)]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [*carry, *names])

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    spark = ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    return rows.mapInArrow(text.tidied(_mapper(vocab.shipped(spark, path), False, ["doc_id"], names), "bpe"), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and ids after its own columns, other than those of these names."""
    spark = ship(docs.sparkSession)
    names = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    carry = [c for c in docs.columns if c not in names and c != "_text"]
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").cast("string").alias("_text"))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(text.tidied(_mapper(vocab.shipped(spark, path), True, carry, names), "bpe"), f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with the token strings of `ids` joined by spaces; a null list decodes to the empty text."""
    spark = ship(encoded.sparkSession)
    source = vocab.shipped(spark, path)

    @F.pandas_udf("string")
    def names(lists):
        t = tokenizer(source.value)
        by_id = dict(zip(t.id_of, t.name, strict=True)) | {i: s for s, i in t.specials.items()}
        return lists.map(lambda x: " ".join([by_id[i] for i in x]) if x is not None else "")

    return encoded.withColumn(to, names(F.col(ids)))
