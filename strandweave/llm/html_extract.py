"""Main text of web pages.

Pages are parsed to blocks; each host's pages are then searched for long token runs that repeat across distinct pages, by
suffix arrays over the host's concatenated token streams, and blocks covered by such runs are boilerplate.

The suffix array alone cannot give the article: an advert may be unique to its page, a host may have one page, and
articles share passages with other pages of their host. So markup decides what it can, and repetition what it leaves
open:

- Elements that never hold the article (nav, footer, aside, form, script, style, ... and those whose class, id or role
  says so: adverts, menus, notices, comments, ...) are dropped, wherever they stand. A name of several parts says so by
  its last part (site-footer), or by its first one where the others say nothing (comment-list, ad1; not comment-policy),
  and not after a word of state (has-sidebar); html, body, main and article are never dropped by names.
- On a page with an article or main element, blocks inside it are kept, unless repetition says that the host puts them
  into its articles: at least COVERED of their tokens lie in runs of RUN tokens or more that occur in the articles of
  more than half of the host's pages that have one, and in OFTEN different ones at least. An article that would lose half of its tokens or more is a copy of
  others, not a frame, and stays whole; so do passages that a few articles share.
- Every other block is open: it is kept unless at least COVERED of its tokens lie in runs of RUN tokens or more that
  occur outside the articles of two pages of the host or more.

A host of more than GROUP pages or GROUP_BYTES is dealt over parts, so that one host with a third of all pages is many
tasks. Runs in more than half of a host's articles are in more than half of those of some chunk of its pages; these
few are then counted over all of its pages. Each part has a suffix array; runs that occur once in each of several parts meet in an aggregation of run hashes,
for the hosts that have open blocks, so the result is that of one array over the whole host whatever its size.

A null or empty page, and one without text, has the empty text. Markup that is not closed ends with the page; a quote
that is not closed ends with its tag; an unknown or malformed URL counts as its own host. Rows with equal page_id are
separate pages. Pages of any length are read whole; a part holds GROUP_BYTES or one page. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import text
from strandweave.session import cut, ship

RUN, COVERED, GROUP, GROUP_BYTES = 6, 0.8, 256, 16_000_000
#: Least articles that hold a run of the host's own; articles of a large host that are looked at together.
OFTEN, CHUNK = 4, 64
#: A join side of at most this many hosts is broadcast.
MOST_HOSTS = 100_000

# Element names of HTML by their part in extraction.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "select"}
NEVER = {"nav", "footer", "aside", "form", "head", "button", "dialog", "menu"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
SIGNS = set("ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices sidebar comment comments disqus reply replies respond nav navbar navigation menu breadcrumb breadcrumbs footer masthead share sharing social related newsletter subscribe signup login popup modal widget complementary contentinfo".split())
OUTSIDE_SIGNS = {"header", "topbar"}
UNSIGNED = {"html", "body", "main", "article"}
#: Parts of a name that say nothing of what an element holds.
PLAIN = set("area bar block body box btn button container content group holder inner item items left link links list main outer panel right row section slot top bottom unit widget wrap wrapper".split())
STATES = {"has", "with", "without", "no", "is", "show", "hide"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _says(parts: list[str], signs: set[str]) -> bool:
    """Whether the parts of one name are a sign: the last one, or the first one with nothing but plain parts after it."""
    if not parts or STATES & set(parts):
        return bool(parts) and parts[0] in signs
    return parts[-1] in signs or (parts[0] in signs and PLAIN >= set(parts[1:]))


def _marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element's name or attributes say that it holds no article text."""
    if name in NEVER or (name == "header" and not inside):
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id", "role"):
            if name in UNSIGNED:
                continue
            signs = SIGNS if inside else SIGNS | OUTSIDE_SIGNS
            if any(_says(parts, signs) for parts in (re.findall("[a-z]+", x) for x in value.split())):
                return True
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
    return False


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, inside an article, dropped by markup) of each block with text, in page order."""
    out: list[tuple[str, bool, bool]] = []
    words: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, article, dropped: of open elements and all around them
    inside = dropped = False

    def flush() -> None:
        if words:
            body = " ".join(html.unescape("".join(words)).split())
            words.clear()
            if body:
                out.append((body, inside, dropped))

    at = 0
    while (m := TAG.search(page, at)) is not None:
        if m.start() > at:
            words.append(page[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            if m[0].startswith("<![CDATA["):
                words.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if closing:
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in BLOCK and stack[k][2] != dropped:
                        flush()
                    del stack[k:]
                    break
                if name not in BLOCK and stack[k][0] in BLOCK:
                    break  # an inline end tag closes nothing across a block
            before = inside, dropped
            inside, dropped = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            if words and before != (inside, dropped):
                (inside, dropped), now = before, (inside, dropped)
                flush()
                inside, dropped = now
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            words.append(" ")
        if name in BLOCK:
            flush()
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        if name == "body" and stack and stack[-1][0] == "head":
            stack.pop()  # a head that was not closed
            inside, dropped = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()
            inside, dropped = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        drop = _marked(name, attributes, inside)
        if name in BLOCK or drop:
            if drop and not dropped:
                flush()
            inside, dropped = inside or name in ("article", "main") and not drop, dropped or drop
            stack.append((name, inside, dropped))
    if at < len(page):
        words.append(page[at:])
    flush()
    return out


def repeated(streams: list[np.ndarray], run: int = RUN, least: int = 2, kinds: np.ndarray | None = None) -> list[np.ndarray]:
    """For each page's token hashes: which tokens lie in runs of `run` tokens or more that occur on `least` pages or more.

    With `kinds`, a number a page, the pages must be of OFTEN kinds, too.

    The suffix array of the concatenated streams is built by prefix doubling until suffixes are ordered by their first
    `run` tokens; suffixes that agree so far stand together, and their pages are compared. Longer runs are unions of these.
    """
    sizes = np.array([len(s) for s in streams])
    total = int(sizes.sum())
    covered = np.zeros(total, dtype=bool)
    if total and (sizes >= run).sum() > 1:
        page = np.repeat(np.arange(len(streams)), sizes)
        rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)  # tokens to the page's end
        rank = np.unique(np.concatenate(streams), return_inverse=True)[1].astype(np.int64)
        done, step = 1, 1
        while done < run:
            step = min(done, run - done)
            nxt = np.full(total, -1, dtype=np.int64)
            nxt[: total - step] = rank[step:]
            nxt[rest <= step] = -1
            order = np.lexsort((nxt, rank))
            new = np.empty(total, dtype=np.int64)
            changed = np.concatenate([[True], (rank[order][1:] != rank[order][:-1]) | (nxt[order][1:] != nxt[order][:-1])])
            new[order] = np.cumsum(changed) - 1
            rank, done = new, done + step
        full = np.flatnonzero(rest >= run)
        suffixes = full[np.argsort(rank[full], kind="stable")]
        groups = np.concatenate([[0], np.flatnonzero(np.diff(rank[suffixes])) + 1])
        of = page[suffixes]  # in page order inside a group, as suffixes are sorted stably
        fresh = np.concatenate([[True], of[1:] != of[:-1]])
        fresh[groups] = True
        sizes_of = np.diff(np.concatenate([groups, [len(suffixes)]]))
        enough = np.add.reduceat(fresh.astype(np.int64), groups) >= least
        if kinds is not None:
            group = np.repeat(np.arange(len(groups)), sizes_of)
            of = kinds[of][np.lexsort((kinds[of], group))]
            fresh = np.concatenate([[True], of[1:] != of[:-1]])
            fresh[groups] = True
            enough &= np.add.reduceat(fresh.astype(np.int64), groups) >= OFTEN
        shared = np.repeat(enough, sizes_of)
        step_up = np.zeros(total + 1, dtype=np.int64)
        np.add.at(step_up, suffixes[shared], 1)
        np.add.at(step_up, np.minimum(suffixes[shared] + run, total), -1)
        covered = np.cumsum(step_up[:-1]) > 0
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return [covered[bounds[i] : bounds[i + 1]] for i in range(len(streams))]


Page = list[tuple[str, bool, bool]]


def streams_of(pages: list[Page]) -> tuple[list[np.ndarray], list[np.ndarray], list[bool]]:
    """Of each page: hashes of the tokens outside its article, the bounds of its blocks in them, whether it has an article."""
    article = [any(inside and not dropped for _, inside, dropped in page) for page in pages]
    bodies = pa.array([b if not (has and inside) else "" for page, has in zip(pages, article, strict=True) for b, inside, _ in page], pa.large_string())
    hashes, bounds = text.word_hashes(bodies)
    firsts = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
    own = [bounds[firsts[i] : firsts[i + 1] + 1] for i in range(len(pages))]
    return [hashes[x[0] : x[-1]] for x in own], [x - x[0] for x in own], article


def run_hashes(stream: np.ndarray, run: int = RUN) -> np.ndarray:
    at = np.arange(max(len(stream) - run + 1, 0))
    return text.runs(stream, at, at + run)


def articles_of(pages: list[Page]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each page: hashes of the tokens of its article, and the bounds of its blocks in them."""
    bodies = pa.array([b if inside and not dropped else "" for page in pages for b, inside, dropped in page], pa.large_string())
    hashes, bounds = text.word_hashes(bodies)
    firsts = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
    own = [bounds[firsts[i] : firsts[i + 1] + 1] for i in range(len(pages))]
    return [hashes[x[0] : x[-1]] for x in own], [x - x[0] for x in own]


def article_id(stream: np.ndarray) -> int:
    """A hash of an article."""
    return int(text.runs(stream, np.array([0]), np.array([len(stream)])).astype(np.int64)[0])


def framed(pages: list[Page], often: np.ndarray | None = None) -> list[np.ndarray]:
    """Of each page: which blocks of its article the host puts into its articles.

    `often` are the runs in more than half of the articles of a host of several parts; without it pages are the whole host.
    """
    streams, bounds = articles_of(pages)
    if often is None:
        full = [i for i, x in enumerate(streams) if len(x)]
        covered = [np.zeros(len(x), dtype=bool) for x in streams]
        if len(full) >= OFTEN:
            kinds = np.array([article_id(streams[i]) for i in full])
            for i, found in zip(full, repeated([streams[i] for i in full], least=len(full) // 2 + 1, kinds=kinds), strict=True):
                covered[i] = found
    else:
        covered = [_covered(x, often) for x in streams]
    out = []
    for mark, own in zip(covered, bounds, strict=True):
        sums, size = np.concatenate([[0], np.cumsum(mark)]), np.diff(own)
        frame = (size > 0) & (sums[own[1:]] - sums[own[:-1]] >= COVERED * size)
        out.append(frame & (2 * size[frame].sum() < size.sum()))
    return out


def _covered(stream: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which tokens lie in one of the runs."""
    step = np.zeros(len(stream) + 1, dtype=np.int64)
    if len(runs) and len(stream) >= RUN:
        at = np.flatnonzero(np.isin(run_hashes(stream), runs))
        np.add.at(step, at, 1)
        np.add.at(step, at + RUN, -1)
    return np.cumsum(step[:-1]) > 0


def main_texts(pages: list[Page], elsewhere: np.ndarray | None = None, often: np.ndarray | None = None) -> list[str]:
    """The main text of each page of one part of a host, from its blocks.

    `elsewhere` are runs that other parts hold, too; `often` those in more than half of the articles of all parts.
    """
    streams, bounds, article = streams_of(pages)
    out = []
    for page, covered, stream, own, has, frame in zip(pages, repeated(streams), streams, bounds, article, framed(pages, often), strict=True):
        if elsewhere is not None:
            covered = covered | _covered(stream, elsewhere)
        sums = np.concatenate([[0], np.cumsum(covered)])
        kept = []
        for k, (body, inside, dropped) in enumerate(page):
            boilerplate = own[k + 1] > own[k] and sums[own[k + 1]] - sums[own[k]] >= COVERED * (own[k + 1] - own[k])
            if not dropped and ((inside and not frame[k]) if has else not boilerplate):
                kept.append(body)
        out.append("\n".join(kept))
    return out


NAMES = ["host", "part", "h", "often", "page_id", "url", "html"]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray | None, list[tuple]]]:
    """((host, part), runs of other parts, runs of most articles, [(page_id, url, html)]) of rows sorted by host and part.

    The `often` of a page says that its host has several parts; that of a run, which of the two kinds it is.
    """

    def made() -> tuple:
        elsewhere, often = (np.array(x, dtype=np.int64).astype(text.U) for x in marks)
        return key, elsewhere, often if several else None, group

    key, marks, group, several = None, ([], []), [], False
    for batch in batches:
        for host, part, h, often, *row in zip(*[batch.column(c).to_pylist() for c in NAMES], strict=True):
            if key != (host, part):
                if group:
                    yield made()
                key, marks, group, several = (host, part), ([], []), [], False
            if h is None:
                group.append(row)
                several = often
            else:
                marks[bool(often)].append(h)
    if group:
        yield made()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of NAMES in groups of (host, part) to (page_id, url, text, n_chars)."""
    for _, elsewhere, often, group in _grouped(batches):
        bodies = main_texts([blocks(g[2] or "") for g in group], elsewhere, often)
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in group], pa.int64()), pa.array([g[1] for g in group], pa.string()), pa.array(bodies, pa.string()), pa.array([len(b) for b in bodies], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to (host, n, h): of chunks of a host's articles their number, and the runs in more than half of them."""
    held: dict[str, list[np.ndarray]] = {}

    def most(host: str) -> pa.RecordBatch:
        streams = held.pop(host)
        runs, times = np.unique(np.concatenate([np.unique(run_hashes(x)) for x in streams]), return_counts=True)
        runs = runs[2 * times > len(streams)].astype(np.int64).tolist()
        return pa.RecordBatch.from_arrays([pa.array([host] * (1 + len(runs)), pa.string()), pa.array([len(streams)] + [None] * len(runs), pa.int64()), pa.array([None, *runs], pa.int64())], ["host", "n", "h"])

    for batch in batches:
        streams, _ = articles_of([blocks(body or "") for body in batch.column("html").to_pylist()])
        for host, stream in zip(batch.column("host").to_pylist(), streams, strict=True):
            if len(stream):
                held.setdefault(host, []).append(stream)
                if len(held[host]) == CHUNK:
                    yield most(host)
        if sum(len(x) for x in held.values()) > 4096:  # many hosts, few pages of each
            yield from [most(host) for host in list(held)]
    yield from [most(host) for host in list(held)]


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, runs) to (host, article, h): which of the runs each article holds."""
    for batch in batches:
        streams, _ = articles_of([blocks(body or "") for body in batch.column("html").to_pylist()])
        out: list[tuple] = []
        for host, stream, runs in zip(batch.column("host").to_pylist(), streams, batch.column("runs").to_pylist(), strict=True):
            if len(stream):
                own = article_id(stream)
                out += [(host, own, h) for h in np.intersect1d(run_hashes(stream).astype(np.int64), runs).tolist()]
        columns = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "article", "h"])


def _is_open(page: Page) -> bool:
    return any(not dropped for _, _, dropped in page) and not any(inside and not dropped for _, inside, dropped in page)


def _open_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hosts of pages with open blocks, once a batch."""
    for batch in batches:
        found = {h for h, body in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True) if _is_open(blocks(body or ""))}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["host"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of (host, part) to (host, part, h, open): each run outside articles once, and whether an open block holds it."""
    for (host, part), _, _, group in _grouped(batches):
        pages = [blocks(g[2] or "") for g in group]
        streams, _, article = streams_of(pages)
        runs = [run_hashes(s) for s in streams]
        every = np.unique(np.concatenate(runs))
        mine = [r for r, page, has in zip(runs, pages, article, strict=True) if not has and _is_open(page)]
        some = np.isin(every, np.concatenate(mine)) if mine else np.zeros(len(every), bool)
        n = len(every)
        yield pa.RecordBatch.from_arrays([pa.array([host] * n, pa.string()), pa.array(np.full(n, part, np.int32)), pa.array(every.astype(np.int64)), pa.array(some)], ["host", "part", "h", "open"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    ship(pages.sparkSession)
    url = F.col("url").cast("string")
    # A page without a host stands alone.
    host = F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")), F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce(url, F.lit(""))))
    rows = pages.select(host.alias("host"), F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"))
    parts = F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum(F.octet_length("html")) / GROUP_BYTES)).cast("int")
    large = cut(rows.groupBy("host").agg(parts.alias("parts")).where("parts > 1"))
    n_large = large.count()
    if n_large <= MOST_HOSTS:
        large = F.broadcast(large)
    parted = rows.join(large, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))).cast("int"))
    parted = parted.select("host", "part", F.lit(None).cast("long").alias("h"), (F.coalesce("parts", F.lit(1)) > 1).alias("often"), "page_id", "url", "html", "parts")
    whole = parted.drop("parts")
    if n_large:
        of_large = parted.where("parts > 1").drop("parts")
        with_open = cut(of_large.select("host", "html").mapInArrow(text.tidied(_open_hosts), "host string").distinct())
        if not with_open.isEmpty():
            runs = cut(_sorted(of_large.join(with_open, "host", "left_semi")).mapInArrow(text.tidied(_runs), "host string, part int, h long, open boolean"))
            # A run is a row a part at most, so a run on every page of a large host is one row a part.
            both = runs.groupBy("host", "h").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.max("open").alias("open")).where("lo < hi and open").select("host", "h")
            marks = runs.where("open").join(both, ["host", "h"]).select("host", "part", "h", F.lit(False).alias("often"))
            whole = whole.unionByName(marks, allowMissingColumns=True)
        # Runs in most articles of a host: those of most articles of a chunk are counted over all articles.
        chunks = cut(of_large.select("host", "html").mapInArrow(text.tidied(_articles), "host string, n long, h long"))
        some = cut(chunks.where("h is not null").groupBy("host").agg(F.collect_set("h").alias("runs")))
        if not some.isEmpty():
            n = chunks.where("n is not null").groupBy("host").agg(F.sum("n").alias("n"))
            held = of_large.select("host", "html").join(some, "host").mapInArrow(text.tidied(_holding), "host string, article long, h long")
            times = held.groupBy("host", "h", "article").agg(F.count("*").alias("k")).groupBy("host", "h").agg(F.count("*").alias("kinds"), F.sum("k").alias("times")).join(n, "host")
            often = times.where((F.col("kinds") >= OFTEN) & (2 * F.col("times") > F.col("n"))).select("host", "h")
            marks = often.join(large, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "h", F.lit(True).alias("often"))
            whole = whole.unionByName(cut(marks), allowMissingColumns=True)
    return _sorted(whole).mapInArrow(text.tidied(_extract), "page_id long, url string, text string, n_chars long")


def _sorted(rows: DataFrame) -> DataFrame:
    """Dealt by (host, part); the runs of other parts come before the pages."""
    return rows.repartition("host", "part").sortWithinPartitions("host", "part", F.col("h").isNull(), "page_id", "url")
