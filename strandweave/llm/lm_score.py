"""Language-model scores by subword lattice likelihood.

The units are the pieces of an existing vocabulary and, as units of their own, the words of the training texts. A word's
lattice holds every segmentation of it into units: all sequences of pieces, and the arc of the whole word where training
has it. A log-space forward recursion sums over all of them, and the score of a text is the log10 of its marginal
probability, the sum over its words and its end.

Pieces start with the vocabulary's own scores (as a rank prior) and take on their expected numbers in the distinct words
of the training texts in ROUNDS rounds of forward and backward recursion. A word ends after a piece with a fixed
probability, so the piece arcs are a distribution over all words; the whole-word arcs take their discounted counts, and
the discount is the mass of the piece arcs. What is gathered from the corpus, the whole-word units, grows with it.

Texts come in languages, so there is one such lattice for each of the CLASSES most frequent values of `lang` among the
training texts (others share the last one; without that column there is one):

    p_z(word) = max(c_z - d, 0) / N_z + (d V_z / N_z) * (SHARED * c / N + (1 - SHARED) * pieces_z(word))
    p_z(end)  = (training texts of z) / N_z

The probability of a text is the mean over classes, weighted by their shares of the training texts, of the product over
its words and its end; lang of the text itself is not looked at. That is a proper probability of the text.

Counts cover all training texts and stay distributed. The HOT most frequent words (a bound on what is broadcast) are
scored where the text is; occurrences of all others meet their counts in a join, one row a text and word.

Null texts count as empty: one token, the end. Repeated rows are scored each. Rows with a null doc_id are training rows.
Without training texts base scores are 0 and the model has the lattice's prior alone. Words of any length are scored
whole: those over LONG_WORD characters in blocks of BLOCK places, with memory for a few numbers a character. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import text, vocab
from strandweave.llm.quality import in_fold
from strandweave.session import cut, ship

U = np.uint64
HOT = 400_000
CLASSES, SHARED = 6, 0.2
PRIOR = 500.0
ROUNDS = 2
FALLBACK = 1e-3
FLUSH = 300_000
GATHER = 40_000
LONG_WORD, BLOCK = 64, 8192
_pieces: dict[str, object] = {}


def processor(source: bytes):
    key = hashlib.sha256(source).hexdigest()
    if key not in _pieces:
        import sentencepiece

        _pieces[key] = sentencepiece.SentencePieceProcessor(model_proto=source)
    return _pieces[key]


def char_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running totals of code points, and inverse powers, for the hash of any span."""
    up, down = text.powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=U)
    np.cumsum((codes.astype(U) + U(1)) * up[: len(codes)], out=total[1:])
    return total, down


@dataclass
class Lattice:
    """Piece weights: hashes in ascending order with ln p of a first piece and of a later one, a row each class."""

    hashes: np.ndarray
    first: np.ndarray
    later: np.ndarray
    widest: int
    stop: np.ndarray

    def of(self, z: int) -> Lattice:
        return Lattice(self.hashes, self.first[z : z + 1], self.later[z : z + 1], self.widest, self.stop[z : z + 1])

    @classmethod
    def joined(cls, parts: list[Lattice]) -> Lattice:
        return cls(parts[0].hashes, np.vstack([x.first for x in parts]), np.vstack([x.later for x in parts]), parts[0].widest, np.concatenate([x.stop for x in parts]))

    @classmethod
    def build(cls, source: bytes, seen: tuple[np.ndarray, np.ndarray] | None = None, ends: float = 0.0, prior: float = PRIOR) -> Lattice:
        """seen: expected numbers of each piece (in the order of hashes) as a first and as a later one, in `ends` words.

        Without them, the vocabulary's own scores alone give the weights.
        """
        sp = processor(source)
        names, lead, rank = [], [], []
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                name = sp.id_to_piece(i)
                if "▁" not in name[1:]:
                    names.append(name)
                    lead.append(name[0] == "▁")
                    # The scores of a merge-made vocabulary are ranks; frequencies fall about as their inverse.
                    rank.append(1 / (3.0 - sp.get_score(i)) if sp.get_score(i) == int(sp.get_score(i)) else np.exp(sp.get_score(i)))
        if "▁" not in names:
            names.append("▁")
            lead.append(True)
            rank.append(1e-3)
        ids = np.concatenate([_span_hash(np.array([ord(c) for c in n])) for n in names])
        order = np.argsort(ids)
        lead, rank = np.array(lead)[order], np.array(rank)[order]
        weights, total = [], 0.0
        for kind, share in ((True, 1.0), (False, 1 - FALLBACK)):
            own = rank * (lead == kind)
            n = seen[0 if kind else 1] * (lead == kind) if seen is not None else np.zeros(len(ids))
            with np.errstate(divide="ignore"):
                weights.append(np.log(share * (n + prior * own / own.sum()) / (n.sum() + prior)))
            total += n.sum()
        stop = (ends + 1.0) / (total + 3.0)  # a word of three pieces, before anything is known
        return cls(ids[order], weights[0][None], weights[1][None], max(map(len, names)), np.array([min(max(stop, 1e-4), 1 - 1e-4)]))

    def score(self, words: list[str]) -> np.ndarray:
        """ln of the marginal probability of each word, a row each class."""
        out = np.full((len(self.stop), len(words)), -np.inf)
        for own, codes in self._alike(words):
            if codes.shape[1] > LONG_WORD:
                out[:, own[0]] = self._far(codes[0])[:, -1] + np.log(self.stop)
            else:
                out[:, own] = self._forward(codes)[0]
        return out

    def expect(self, words: list[str], seen: np.ndarray) -> None:
        """Add the expected numbers of pieces in the words, each counted once, to seen[0] (first) and seen[1] (later); of one class."""
        for _, codes in self._alike(words):
            if codes.shape[1] > LONG_WORD:
                self._expect_far(codes[0], seen)
                continue
            whole, forward, edges = self._forward(codes, keep=True)
            rows, size = codes.shape
            backward = [np.full((1, rows), -np.inf) for _ in range(size)] + [np.full((1, rows), np.log(self.stop[0]))]
            for end in range(size, 0, -1):
                for begin, at, piece, weight in edges[end]:
                    # `piece` leaves the fallback out, `weight` has it.
                    share = np.exp(forward[begin] + piece + backward[end] - whole)[0]
                    some = share > 0
                    seen[0 if begin == 0 else 1] += np.bincount(at[some], weights=share[some], minlength=seen.shape[1])
                    backward[begin] = np.logaddexp(backward[begin], weight + backward[end])

    def _steps(self, codes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pieces that begin at low..high-1 of a long word: places in the vocabulary, ln weight without and with the fallback; [class,] length - 1, begin."""
        size, widest, classes = len(codes), self.widest, len(self.stop)
        total, down = char_hashes(codes[low : min(size, high + widest)])
        n = high - low
        at = np.zeros((widest, n), dtype=np.int64)
        piece = np.full((classes, widest, n), -np.inf)
        begin = np.arange(n)
        go_on = np.where(begin + low > 0, np.log1p(-self.stop)[:, None], 0.0)
        for length in range(1, widest + 1):
            b = begin[begin + low + length <= size]
            if not len(b):
                break
            h = text.mix((total[b + length] - total[b]) * down[b] + U(length))
            i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            at[length - 1, : len(b)] = i
            found = self.hashes[i] == h
            piece[:, length - 1, : len(b)] = np.where(found, np.where(b + low > 0, self.later[:, i], self.first[:, i]) + go_on[:, : len(b)], -np.inf)
        weight = piece.copy()
        own = codes[low:high]
        width = np.where(own < 0x80, 1, np.where(own < 0x800, 2, np.where(own < 0x10000, 3, 4)))
        single = np.where(begin + low > 0, np.log(FALLBACK) - width * np.log(256.0), -np.inf)
        weight[:, 0] = np.logaddexp(weight[:, 0], single + go_on)
        return at, piece, weight

    def _far(self, codes: np.ndarray) -> np.ndarray:
        """ln of the forward sums at every place of one long word, a row each class."""
        size, widest, classes = len(codes), self.widest, len(self.stop)
        out = np.full((classes, size + widest + 1), -np.inf)
        out[:, 0] = 0.0
        for low in range(0, size, BLOCK):
            high = min(size, low + BLOCK)
            weight = np.ascontiguousarray(self._steps(codes, low, high)[2].transpose(2, 0, 1))
            for begin in range(low, high):
                ahead = out[:, begin + 1 : begin + 1 + widest]
                np.logaddexp(ahead, out[:, begin : begin + 1] + weight[begin - low], out=ahead)
        return out[:, : size + 1]

    def _expect_far(self, codes: np.ndarray, seen: np.ndarray) -> None:
        """What `expect` adds for one long word; of one class."""
        size, widest = len(codes), self.widest
        forward = self._far(codes)[0]
        backward = np.full(size + widest + 1, -np.inf)
        backward[size] = np.log(self.stop[0])
        whole = forward[size] + backward[size]
        for low in range((size - 1) // BLOCK * BLOCK, -1, -BLOCK):
            high = min(size, low + BLOCK)
            at, piece, weight = self._steps(codes, low, high)
            down = np.ascontiguousarray(weight[0].T)
            for begin in range(high - 1, low - 1, -1):
                backward[begin] = np.logaddexp.reduce(down[begin - low] + backward[begin + 1 : begin + 1 + widest])
            for length in range(1, widest + 1):
                begin = np.arange(low, high)
                share = np.exp(forward[low:high] + piece[0, length - 1] + backward[low + length : high + length] - whole)
                for row, here in ((0, begin == 0), (1, begin > 0)):
                    some = here & (share > 0)
                    seen[row] += np.bincount(at[length - 1][some], weights=share[some], minlength=seen.shape[1])

    @staticmethod
    def _alike(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Words of equal length: their places, and their code points after the word mark, one row each."""
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        for size, places in by_size.items():
            step = 4096 if size < LONG_WORD else 1
            for a in range(0, len(places), step):
                own = places[a : a + step]
                codes = np.frombuffer("".join([words[i] for i in own]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(own), size)
                yield own, np.hstack([np.full((len(own), 1), 0x2581, np.uint32), codes])

    def _forward(self, codes: np.ndarray, keep: bool = False):
        """Forward recursion over words of equal length: ln of the marginals; with `keep` also all positions and edges."""
        rows, size = codes.shape
        total, down = char_hashes(codes.reshape(-1))
        base = np.arange(rows) * size
        width = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
        fallback = np.log(FALLBACK) - width * np.log(256.0)
        go_on, stop = np.log1p(-self.stop)[:, None], np.log(self.stop)[:, None]
        classes = len(self.stop)
        forward, edges = {0: np.zeros((classes, rows))}, {}
        for end in range(1, size + 1):
            best, own = np.full((classes, rows), -np.inf), []
            for begin in range(max(0, end - self.widest), end):
                h = text.mix((total[base + end] - total[base + begin]) * down[base + begin] + U(end - begin))
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                found = self.hashes[at] == h
                single = begin > 0 and end - begin == 1
                if not single and not found.any():
                    continue
                piece = weight = np.where(found, (self.first if begin == 0 else self.later)[:, at] + (go_on if begin else 0.0), -np.inf)
                if single:
                    weight = np.logaddexp(weight, fallback[:, begin] + go_on)
                best = np.logaddexp(best, forward[begin] + weight)
                if keep:
                    own.append((begin, at, piece, weight))
            forward[end] = best
            if keep:
                edges[end] = own
            else:
                forward.pop(end - self.widest - 1, None)
        return forward[size] + stop, forward, edges


def _span_hash(codes: np.ndarray) -> np.ndarray:
    total, _ = char_hashes(codes)
    return text.mix(total[-1:] + U(len(codes)))


@dataclass
class Statistics:
    """Of the training tokens, over all and (arrays) by class; words excludes the ends."""

    words: int
    types: int
    texts: int
    discount: float
    class_words: np.ndarray
    class_types: np.ndarray
    class_texts: np.ndarray

    @property
    def tokens(self) -> int:
        return self.words + self.texts

    @property
    def vocabulary(self) -> int:
        return self.types + (self.texts > 0)

    def base(self, c):
        return np.log10((c + 1) / (self.tokens + 1 * (self.vocabulary + 1)))

    def static(self, c: np.ndarray, by_class: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """p_z(word) from its count, its counts by class and ln lattice_z, a row each class."""
        if not self.tokens:
            return 0.5 * np.exp(lattice)
        n = (self.class_words + self.class_texts)[:, None]
        # A class of texts without words has no mass to discount; what it would give words goes to the rest.
        free = np.where(self.class_types > 0, self.discount * self.class_types / np.maximum(n[:, 0], 1), 0.0)[:, None]
        shared = SHARED * c / self.words if self.words else 0.0
        return np.maximum(by_class - self.discount, 0) / n + np.maximum(free, 1e-9) * (shared + (1 - SHARED) * np.exp(lattice))

    @property
    def end(self) -> np.ndarray:
        return self.class_texts / (self.class_words + self.class_texts) if self.tokens else np.array([0.5])

    @property
    def share(self) -> np.ndarray:
        return self.class_texts / self.texts if self.texts else np.array([1.0])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(z, text) to (word, z, c): counts of a task's words by class; what is held is bounded."""
    from collections import Counter, defaultdict

    held: dict[int, Counter] = defaultdict(Counter)

    def give() -> Iterator[pa.RecordBatch]:
        for z, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()).cast(pa.string()), pa.array([z] * len(own), pa.int32()), pa.array(list(own.values()), pa.int64())], ["word", "z", "c"])
        held.clear()

    for batch in batches:
        for z, body in zip(batch.column("z").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            for stretch in vocab.stretches(body.as_py() or b""):
                held[z].update(stretch.lower().split())
            if len(held[z]) > FLUSH:
                yield from give()
    yield from give()


def _expected(model) -> Callable:
    """(word, cs) to (z, piece, first, later): a task's expected numbers of pieces by class; piece -1 has the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        classes = len(m.stop)
        seen, ends = np.zeros((classes, 2, len(m.hashes))), np.zeros(classes)
        for batch in text.gathered(batches, GATHER):
            cs = counts_of(batch.column("cs"), classes)
            words = batch.column("word").to_pylist()
            for z in range(classes):
                own = [words[i] for i in np.flatnonzero(cs[z])]
                ends[z] += len(own)
                m.of(z).expect(own, seen[z])
        for z in range(classes):
            some = np.flatnonzero(seen[z].sum(axis=0) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some) + 1, z, np.int32)), pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(seen[z, 0, some], ends[z])), pa.array(np.append(seen[z, 1, some], 0.0))], ["z", "piece", "first", "later"])

    return run


def counts_of(column: pa.Array, classes: int) -> np.ndarray:
    """A list column of counts by class as an array, a row each class; null is all 0."""
    out = np.zeros((len(column), classes))
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    out[there] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(there), classes)
    return out.T


def _hot_words(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.gathered(batches, GATHER):
            if batch.num_rows:
                words = batch.column("word")
                hashes, _ = text.word_hashes(words)
                lat = model.value.score(words.to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), batch.column("c"), batch.column("cs"), pa.array(list(lat.T), pa.list_(pa.float64()))], ["h", "c", "cs", "lat"])

    return run


DOC = "rid long, doc_id long, held_out boolean, word string, m int, n_tokens long, n_known long, base double, scores array<double>"
DOC_NAMES = [f.split()[0] for f in DOC.split(", ")]


def _texts(stats: Statistics, hot) -> Callable:
    """(rid, doc_id, held_out, text) to one row a text (word null) and one for each of its words that is not hot (doc_id null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, static = hot.value
        for batch in batches:
            for part in text.pieces(batch, "text", 1 << 19):
                rows = part.num_rows
                data, offsets = text.raw(part.column("text"))
                data = text.lower(data)
                begins, ends, bounds = text.spans(data, offsets)
                h = text.span_hashes(data, begins, ends)
                n = np.diff(bounds)
                row = np.repeat(np.arange(rows), n)
                order = np.lexsort((h, row))
                hs, rs = h[order], row[order]
                new = np.ones(len(hs), dtype=bool)
                new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
                heads = np.flatnonzero(new)
                size = np.diff(np.concatenate([heads, [len(hs)]]))
                at = np.minimum(np.searchsorted(hashes, hs[heads]), max(len(hashes) - 1, 0))
                known = hashes[at] == hs[heads] if len(hashes) else np.zeros(len(heads), bool)
                score = np.stack([np.bincount(rs[heads][known], weights=size[known] * p[at[known]], minlength=rows) for p in static])
                c = np.where(known, counts[at], 0) if len(hashes) else np.zeros(len(heads))
                base = np.bincount(rs[heads][known], weights=size[known] * stats.base(c[known]), minlength=rows)
                n_known = np.bincount(rs[heads][known], weights=size[known], minlength=rows).astype(np.int64)
                score += np.log10(np.maximum(stats.end, 1e-300))[:, None]
                base = base + stats.base(float(stats.texts))
                rid = part.column("rid").to_numpy()
                none = lambda kind, m: pa.nulls(m, kind)
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), part.column("held_out"), none(pa.string(), rows), none(pa.int32(), rows), pa.array(n + 1), pa.array(n_known + (stats.texts > 0)), pa.array(base), pa.array(list(score.T), pa.list_(pa.float64()))], DOC_NAMES)
                rare = np.flatnonzero(~known)
                if len(rare):
                    first = order[heads[rare]]
                    width = ends[first] - begins[first]
                    place = np.repeat(begins[first] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
                    words = pa.LargeStringArray.from_buffers(len(rare), pa.py_buffer(np.concatenate([[0], np.cumsum(width)]).astype(np.int64).tobytes()), pa.py_buffer(data[place].tobytes())).cast(pa.string())
                    m = len(rare)
                    yield pa.RecordBatch.from_arrays([pa.array(rid[rs[heads[rare]]]), none(pa.int64(), m), none(pa.bool_(), m), words, pa.array(size[rare].astype(np.int32)), none(pa.int64(), m), none(pa.int64(), m), none(pa.float64(), m), none(pa.list_(pa.float64()), m)], DOC_NAMES)

    return run


def _rare(stats: Statistics, model) -> Callable:
    """(rid, word, m, c, cs) to (rid, n_known, base, s0, s1, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.gathered(batches, GATHER):
            coded = batch.column("word").dictionary_encode()
            classes = len(model.value.stop)
            lat = model.value.score(coded.dictionary.to_pylist())[:, coded.indices.to_numpy()]
            c = batch.column("c").to_numpy(zero_copy_only=False)
            m = batch.column("m").to_numpy()
            p = stats.static(c, counts_of(batch.column("cs"), classes), lat)
            scores = m * np.log10(p)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(np.where(c > 0, m, 0).astype(np.int64)), pa.array(m * stats.base(c.astype(np.float64))), *map(pa.array, scores)], ["rid", "n_known", "base", *[f"s{z}" for z in range(classes)]])

    return run


def fit(docs: DataFrame, path: str, held_out) -> tuple[DataFrame, Statistics, Lattice]:
    """(word counts, statistics, lattices) from the texts (text, lang) that are not held out."""
    spark = ship(docs.sparkSession)
    source = vocab.shipped(spark, path)
    train = docs.where(~held_out)
    by_lang = train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(CLASSES).collect()
    classes = max(1, len(by_lang))
    z = F.lit(classes - 1)
    for i, r in enumerate(by_lang[:-1]):
        z = F.when(F.col("lang").eqNullSafe(F.lit(r["lang"])), F.lit(i)).otherwise(z)
    counted = train.select(z.cast("int").alias("z"), "text").mapInArrow(text.tidied(_count), "word string, z int, c long")
    own = [F.coalesce(F.sum(F.when(F.col("z") == i, F.col("c"))), F.lit(0)) for i in range(classes)]
    counts = cut(counted.groupBy("word").agg(F.sum("c").alias("c"), F.array(*own).alias("cs")))
    each = [f(F.col("cs")[i]).alias(f"{n}{i}") for i in range(classes) for n, f in (("n", F.sum), ("v", lambda x: F.count(F.when(x > 0, 1))))]
    s = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("n_1"), F.count(F.when(F.col("c") == 2, 1)).alias("n_2"), *each).first()
    texts = {r["z"]: r["count"] for r in train.groupBy(z.alias("z")).count().collect()}
    discount = min(max(s["n_1"] / (s["n_1"] + 2 * s["n_2"]), 0.1), 0.95) if s["n_1"] else 0.5
    by_class = [np.array([float(x or 0) for x in row]) for row in ([s[f"n{i}"] for i in range(classes)], [s[f"v{i}"] for i in range(classes)], [texts.get(i, 0) for i in range(classes)])]
    stats = Statistics(int(s["n"] or 0), int(s["v"]), sum(texts.values()), discount, *by_class)
    lattice = Lattice.joined([Lattice.build(source.value)] * classes)
    for _ in range(ROUNDS if stats.types else 0):
        shared = spark.sparkContext.broadcast(lattice)
        # One row a class and piece of the vocabulary at most, and one for the number of words.
        tally = counts.select("word", "cs").mapInArrow(text.tidied(_expected(shared)), "z int, piece int, first double, later double").groupBy("z", "piece").agg(F.sum("first").alias("first"), F.sum("later").alias("later")).toArrow()
        zs, pieces, first, later = (tally.column(c).to_numpy() for c in ("z", "piece", "first", "later"))
        parts = []
        for k in range(classes):
            seen = np.zeros((2, len(lattice.hashes)))
            mine = (zs == k) & (pieces >= 0)
            seen[0, pieces[mine]], seen[1, pieces[mine]] = first[mine], later[mine]
            parts.append(Lattice.build(source.value, (seen[0], seen[1]), float(first[(zs == k) & (pieces < 0)].sum())))
        lattice = Lattice.joined(parts)
        shared.destroy()
    return counts, stats, lattice


def lm_scores(docs: DataFrame, path: str, parts: int = 7, fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold("doc_id", parts, fold).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")).alias("lang"))
    counts, stats, lattice = fit(rows, path, F.col("held_out"))
    model = spark.sparkContext.broadcast(lattice)
    # The least frequency at which no more than HOT words remain, from at most a few hundred classes of frequencies.
    level = F.floor(F.log2("c") * 8).cast("int")
    left, least = HOT, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        left -= r["count"]
        if left < 0:
            break
        least = r["level"]
    is_hot = F.lit(False) if least is None else level >= least
    table = counts.where(is_hot).mapInArrow(text.tidied(_hot_words(model)), "h long, c long, cs array<long>, lat array<double>").toArrow().combine_chunks()
    classes = len(lattice.stop)
    column = lambda name: (lambda x: x.chunk(0) if x.num_chunks else pa.array([], x.type))(table.column(name))
    h = column("h").to_numpy().astype(U)
    order = np.argsort(h)
    c = column("c").to_numpy()
    hot = spark.sparkContext.broadcast((h[order], c[order], np.log10(stats.static(c, counts_of(column("cs"), classes), counts_of(column("lat"), classes))[:, order])))
    scored = cut(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text").mapInArrow(text.tidied(_texts(stats, hot)), DOC))
    rare = scored.where("word is not null").select("rid", "word", "m")
    rare = rare.join(counts.where(~is_hot), "word", "left").select("rid", "word", "m", F.coalesce("c", F.lit(0)).cast("long").alias("c"), "cs")
    names = [f"s{z}" for z in range(classes)]
    sums = rare.mapInArrow(text.tidied(_rare(stats, model)), "rid long, n_known long, base double" + "".join(f", {n} double" for n in names)).groupBy("rid")
    sums = sums.agg(F.sum("n_known").alias("k"), F.sum("base").alias("b"), *[F.sum(n).alias(n) for n in names])
    whole = scored.where("word is null").join(sums, "rid", "left")
    zero = F.lit(0.0)
    logs = [F.col("scores")[z] + F.coalesce(n, zero) + F.lit(float(np.log10(w))) for z, (n, w) in enumerate(zip(names, stats.share, strict=True)) if w > 0]
    whole = whole.withColumn("_most", F.greatest(*logs) if len(logs) > 1 else logs[0])
    score = F.col("_most") + F.log10(sum((F.pow(F.lit(10.0), x - F.col("_most")) for x in logs[1:]), F.pow(F.lit(10.0), logs[0] - F.col("_most"))))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(stats.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", zero)).alias("base_score"), score.alias("score"))
