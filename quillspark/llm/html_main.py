"""Main text of web pages: page structure, and runs of tokens that a host's pages repeat.

A page becomes blocks of text; those inside page furniture (by tag, role, class or id) are dropped. The blocks that
are left are the page's stream of tokens, and a host's streams together are what a suffix array sorts: a run of RUN
tokens that stands in PAGES pages of different content, of all pages of the host, is boilerplate. Outside an article or
main element every position is looked at. Inside one the first and the last run of each block are, and of SAMPLE
neighbours the position of least hash: so a repeated block of RUN tokens or more is covered as a whole, and any other
repeated run but for less than SAMPLE tokens at each end.

Suffixes that agree in their first RUN tokens are put together by a 64-bit hash of these and of the host, in buckets of
hashes, so a host of any size is counted as a whole and no task holds a host. Of each run only its hash and its page's
content are shuffled; pages without boilerplate are done where they are read.

Outside an article or main element covered tokens are dropped wherever they stand. Inside one, where articles may quote
each other, they are dropped by whole blocks: a block stays whole if it is a heading, a quotation or preformatted, if
some of its tokens are the page's own, or if more than half of the article's tokens are covered, which then is a near copy of
other articles.

Defined results: a null html counts as empty and gives an empty text; a null or unreadable url counts as the
host ''; a page in which no text is left gives an empty text; repeated rows are returned as often as given and rows with
a null identifier like others; markup without an end runs to the end of the page; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets
from .ngram_join import _mix
from .runtime import bit_filter, filter_hits, materialize, tidied

RUN, PAGES, SAMPLE = 8, 3, 5
#: Tokens kept in a worker's table of hashes; beyond that it is emptied.
TABLE_SIZE = 400_000

# HTML's element names by their effect on text, and names by which pages mark furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea title head select".split())
FURNITURE = frozenset("nav footer aside form button menu dialog".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr big strike ruby rb rt rp".split())
#: What a start tag ends where the end tag was left out: these if innermost, a paragraph whatever inline markup is open in it.
ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section table ul".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|notification|alert|gdpr|nav\w*|menu|breadcrumbs?|sidebar|side|footer|header|masthead|topbar|share|sharing|social|related|"
    r"newsletter|subscribe|subscription|signup|login|search|comment|comments|disqus|reply|replies|respond|popup|modal|overlay|widget|toolbar|pagination|pager)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: The same inside an article, where its own header, sections and notes may be named by the other words.
MARKED_INSIDE = re.compile(
    r"(?:^|\s)(?:ad|ads|advert\w*|adsense|ad[-_]\w+|\w+[-_]ads?|sponsor\w*|promo\w*|banner|cookie[\w-]*|consent|notice|notification|gdpr|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|site[-_](?:header|footer)|"
    r"shar(?:e|ing)(?:[-_]\w+)*|social(?:[-_]\w+)*|related[-_](?:posts|articles|links|stories|content)|newsletter[\w-]*|subscribe[\w-]*|subscription|signup|login|search[-_]form|comments?(?:[-_](?:list|area|section|form|thread|box|body|text))?|"
    r"comments?[-_]?\d+|disqus\w*|respond|repl(?:y|ies)|popup|modal|overlay|widget|toolbar|pagination|pager)(?=$|\s)",
    re.I,
)
#: Blocks that stay inside an article though other pages hold them.
PROTECTED = frozenset("h1 h2 h3 h4 h5 h6 blockquote pre".split())
OUTSIDE, ARTICLE, KEPT = 0, 1, 2
#: A tag from its < to its >; a quote counts where a value begins, and no alternative gives back what it took.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTR = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""", re.I)
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*+>", re.I) for name in RAW}


def _is_furniture(name: str, attrs: str, inside: bool) -> bool:
    if name in FURNITURE or name == "header" and not inside:
        return True
    if name in ("html", "body", "article", "main") or not attrs or "=" not in attrs:
        return False
    marked = MARKED_INSIDE if inside else MARKED
    for key, *values in _ATTR.findall(attrs):
        value = "".join(values)
        if key.lower() == "role" and value.lower() in ROLES or key.lower() in ("class", "id") and marked.search(value):
            return True
    return False


def blocks(html: str) -> list[tuple[int, str]]:
    """The page's blocks in order, without furniture: (OUTSIDE, ARTICLE or, protected inside an article, KEPT; text).

    One pass: each character is looked at a bounded number of times, whatever the markup.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, furniture, main, protected
    opened: Counter[str] = Counter()
    text: list[str] = []
    hidden = main = kept = 0
    unclosed: set[str] = set()

    def end() -> None:
        if text:
            words = " ".join("".join(map(unescape, text)).split())  # a reference does not go on behind a tag
            if words:
                out.append((OUTSIDE if not main else KEPT if kept else ARTICLE, words))
            text.clear()

    def leave() -> str:
        nonlocal hidden, main, kept
        own, furniture, is_main, is_kept = stack.pop()
        opened[own] -= 1
        hidden -= furniture
        main -= is_main
        kept -= is_kept
        return own

    at, n, last, start = 0, len(html), html.rfind(">"), 0
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            break
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            if not hidden:
                text.append(html[start:lt])
            at = start = n if stop < 0 else stop + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            if not hidden:
                text.append(html[start:lt])
            stop = html.find(">", lt)
            at = start = n if stop < 0 else stop + 1
            continue
        m = _TAG.match(html, lt) if lt < last else None
        if not m:
            if lt < last and re.match("</?[a-zA-Z]", html[lt : lt + 3]):  # a quote without an end
                if not hidden:
                    text.append(html[start:lt])
                at = start = html.find(">", lt) + 1
            else:
                at = lt + 1  # a character like others
            continue
        if lt > start and not hidden:
            text.append(html[start:lt])
        at = start = m.end()
        name = m[2].lower()
        if name not in INLINE:
            end()
        if m[1]:
            if opened[name]:
                while leave() != name:
                    pass
            continue
        if opened["p"] and name in ENDS_P:
            while leave() != "p":
                pass
        if name in ENDED:
            while stack and stack[-1][0] in ENDED[name]:
                leave()
        if name in RAW:
            close = None if name in unclosed else _CLOSE[name].search(html, at)
            if not close:
                unclosed.add(name)
            if close or name not in ("head", "select"):
                at = start = close.end() if close else n
        elif name not in VOID:
            furniture, is_main = _is_furniture(name, m[3], main > 0), name in ("article", "main")
            if name == "p" and not furniture:  # nothing to be undone where it ends
                continue
            stack.append((name, furniture, is_main, name in PROTECTED))
            opened[name] += 1
            hidden += furniture
            main += is_main
            kept += name in PROTECTED
    if start < n and not hidden:
        text.append(html[start:])
    end()
    return out


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Hashes(dict):
    """The hashes of tokens met so far."""

    def __missing__(self, token: str) -> int:
        if len(self) >= TABLE_SIZE:
            self.clear()
        self[token] = own = _hash(token)
        return own


def _grams(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """The hash of each run of n tokens on the host that gave the salt."""
    size = len(h) - n + 1
    out, odd = np.full(size, salt, np.uint64), 1
    for k in range(n):  # each place has an odd factor of its own
        odd = odd * 0xD6E8FEB86659FD93 % (1 << 64)
        out += h[k : size + k] * np.uint64(odd)
    return _mix(out)


def stream(own: list[tuple[int, str]]) -> list[str]:
    """The tokens of a page."""
    return [t for _, text in own for t in text.split(" ")]


def content(host: str, tokens: list[str]) -> int:
    """What pages of one host have in common if their tokens are the same."""
    return _hash(host + "\0" + " ".join(tokens)) - (1 << 63)


def runs(host: str, own: list[tuple[int, str]], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The positions of a stream that are looked at, and the hash of the run of RUN tokens at each."""
    tokens = stream(own)
    if len(tokens) < RUN:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _grams(np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens)), RUN, _hash(host))
    outside = np.repeat([place == OUTSIDE for place, _ in own], [text.count(" ") + 1 for _, text in own])[: len(h)]
    looked = outside.copy()
    if len(h) < SAMPLE:
        looked[h.argmin()] = True
    else:
        looked[np.lib.stride_tricks.sliding_window_view(h, SAMPLE).argmin(axis=1) + np.arange(len(h) - SAMPLE + 1)] = True
    ends = np.cumsum([text.count(" ") + 1 for _, text in own])
    for start, end in zip(np.append(0, ends), ends):
        if end - start >= RUN:
            looked[[start, end - RUN]] = True
    at = np.flatnonzero(looked)
    return at, h[at]


def _covers(rows: DataFrame) -> DataFrame:
    """For each content with boilerplate: the keys of its sampled runs that PAGES contents of its host hold."""
    total = rows.agg(F.sum(F.length("html"))).first()[0] or 0
    parts = buckets.count(total // 20)  # a token has 6 characters and more, and a third of the positions are sampled

    def ship_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, refs, size = Hashes(), [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    page = blocks(html or "")
                    own = np.unique(runs(host, page, hashes)[1])
                    if len(own):
                        held.append(own)
                        refs.append(content(host, stream(page)))
                        size += len(own)
                if size >= buckets.CHUNK:
                    yield buckets.batch(buckets.shipped(*_once(held, refs), parts, PAGES))
                    held, refs, size = [], [], 0
        if refs:
            yield buckets.batch(buckets.shipped(*_once(held, refs), parts, PAGES))

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        refs, keys = buckets.shared(zip(rows["known"], rows["keys"], rows["refs"], rows["times"]), int(rows["bucket"].iloc[0]), PAGES)
        order = np.argsort(refs, kind="stable")
        refs, keys = refs[order], keys[order]
        names, first = np.unique(refs, return_index=True)
        return pd.DataFrame({"content": names, "keys": [k.astype("<u8").tobytes() for k in np.split(keys, first[1:])] if len(names) else []})

    found = rows.select("host", "html").mapInArrow(tidied(ship_out), buckets.SCHEMA).groupBy("bucket").applyInPandas(find, "content long, keys binary")
    return materialize(found.groupBy("content").agg(F.collect_list("keys").alias("keys"), F.lit(parts).alias("parts")), "html-covers")


def _once(held: list[np.ndarray], refs: list[int]) -> tuple[list[np.ndarray], list[int]]:
    """The same without repeated contents."""
    own = dict(zip(refs, held))
    return list(own.values()), list(own)


def main_text(own: list[tuple[int, str]], starts: np.ndarray | list[int] | None) -> str:
    """The page's text without the boilerplate: the runs of RUN tokens that begin at these positions of its stream."""
    if starts is None or not len(starts):
        return " ".join(text for _, text in own)
    lists = [text.split(" ") for _, text in own]
    covered = np.zeros(sum(map(len, lists)), bool)
    for start in starts:
        covered[start : start + RUN] = True
    covers = np.split(covered, np.cumsum([len(tokens) for tokens in lists])[:-1])
    inside = [c for (place, _), c in zip(own, covers) if place != OUTSIDE]
    copied = 2 * sum(int(c.sum()) for c in inside) > sum(map(len, inside))
    out = []
    for (place, text), tokens, c in zip(own, lists, covers):
        if place == OUTSIDE:
            out += [t for t, x in zip(tokens, c) if not x]
        elif place == KEPT or copied or not c.all():
            out.append(text)
    return " ".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(host.alias("host"), F.col(html_col).alias("html"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    covers = _covers(rows)
    kind = pages.schema[id_col].dataType.simpleString()
    block = pa.list_(pa.struct([("place", pa.int32()), ("text", pa.string())]))

    def parse(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    found = [blocks(html or "") for html in part.column(1).to_pylist()]
                    names = [content(host, stream(own)) for host, own in zip(part.column(0).to_pylist(), found)]
                    held = pa.array([[{"place": place, "text": text} for place, text in own] for own in found], block) if whole else pa.array([main_text(own, None) for own in found], pa.string())
                    yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), part.column(0), pa.array(names, pa.int64()), held], ["page_id", "url", "host", "content", "held"])

        return rows.mapInArrow(tidied(run), f"page_id {kind}, url string, host string, content long, held {'array<struct<place:int,text:string>>' if whole else 'string'}")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, texts = batch.slice(i, 256), []
                for host, own, keys, parts in zip(*(part.column(k).to_pylist() for k in (2, 3, 4, 5))):
                    own, starts = [(b["place"], b["text"]) for b in own], None
                    if keys:
                        at, found = runs(host, own, hashes)
                        starts = at[np.isin(buckets.keys_of(found, parts), np.frombuffer(b"".join(keys), "<u8"))]
                    texts.append(main_text(own, starts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    bits = bit_filter(covers, "content")
    sure = filter_hits(parse(False), bits, [F.col("content")], "hit").where("not hit").select("page_id", "url", F.col("held").alias("text"))
    maybe = filter_hits(parse(True), bits, [F.col("content")], "hit").where("hit").join(covers, "content", "left")
    done = maybe.select("page_id", "url", "host", "held", "keys", "parts").mapInArrow(tidied(finish), f"page_id {kind}, url string, text string")
    return sure.unionByName(done).withColumn("n_chars", F.length("text").cast("long"))
