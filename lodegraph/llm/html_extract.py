"""HTML extraction: the main text of web pages.

A page is cut into segments of text with what its markup says of them:
- gone: scripts, styles, forms, menus, headers, footers, asides, and elements whose
  class, id or role names them adverts, notices, comments, menus and the like; but no
  wrapper in which an article begins, and no words inside of a sentence;
- sure: prose (headings, paragraphs, lists, tables, quotes) inside the article, of
  several articles the longest, of nested ones the outer;
- open: the rest. Other text inside the article, elements in it that an id or a part of a class
  puts in doubt, and all text of a page without one.

Markup can't judge open text, so a suffix array by host does. The open tokens of a
host's pages, page by page, are one sequence each; prefix doubling ranks their
suffixes, and a stretch of RUN tokens or more that stands on PAGES or more different
pages of the host is boilerplate. Covered tokens go, unique runs stay. Pages with
the same text, sure and open, count as one, so that copies of a page don't erase each
other; pages that have only their open text in common count each.

Sure text is not put to this test: an article copied to a second page of its host
is still that page's article. With trust=False nothing is sure or gone but scripts, styles and the like,
and the suffix array alone judges all text; that loses articles that are copied and keeps menus
of hosts with few pages, so it is not the default.

A page is parsed once; what it holds is kept, and pages without open text are done.

Defined cases: null html is an empty page; a null url is the host ''; a page
without main text gives an empty text; equal pages give equal texts; columns with the
names of outputs are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.llm import doubling
from lodegraph.llm.common import append, discard, fresh, join_hot, map_in_arrow, materialise, with_columns_schema

RUN, PAGES = 8, 3
#: Rows of marks that are sent to all executors; more are joined.
SENT_MARKS = 200_000
#: Elements by their part in a page.
RAW = "script|style|noscript|template|iframe|svg|math|canvas|object|textarea|select|title"
GONE = frozenset("nav footer aside form button menu dialog fieldset label option input head audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Words of a class, id or role that tell of something besides the article.
MARKED = frozenset("ad ads adv advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets alert complementary contentinfo".split())

_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<({RAW})\b(?:"[^"]*"|'[^']*'|[^<>"'])*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^<>"'])*+)>|<(/?)([a-z][a-z0-9:-]*)([^<>]*)>|<[!?/][^<>]*>""", re.I | re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_BODY = re.compile(r"""itemprop\s*=\s*["']?articlebody|role\s*=\s*["']?(?:main|article)\b""", re.I)

#: What an element's class, role and id say: nothing, that it may be something besides the article, that it is, that it isn't shown.
PLAIN, WEAK, STRONG, UNSEEN = 0, 1, 2, 3


def _mark(attributes: str) -> int:
    """STRONG by a class that is a marked word as a whole, or by a role; WEAK by a part of a class, or by an id."""
    if not attributes.strip():
        return PLAIN
    if _HIDDEN.search(attributes):
        return UNSEEN
    found = PLAIN
    for m in _NAMES.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
            if not MARKED.isdisjoint(parts):
                whole = m[1].lower() != "id" and len([p for p in parts if p]) == 1
                found = max(found, STRONG if whole else WEAK)
    return found


class _Open:
    """The elements that are open, and how many of each tag, so that a stray end tag is known at once."""

    def __init__(self):
        self.stack: list[tuple] = []
        self.count: dict[str, int] = {}

    def push(self, tag: str, *more) -> None:
        self.stack.append((tag, *more))
        self.count[tag] = self.count.get(tag, 0) + 1

    def of(self, tag: str) -> int:
        return self.count.get(tag, 0)

    def ended(self, tag: str) -> list[tuple]:
        """The elements that the end tag closes, inner ones first."""
        out = []
        while self.of(tag):
            out.append(self.stack.pop())
            self.count[out[-1][0]] -= 1
            if out[-1][0] == tag:
                break
        return out


def _tags(html: str) -> list[tuple[int, int, bool, str, str]]:
    """(start, end, end tag, name or '', attributes) of all tags, comments and raw elements; the last two have no name."""
    out = []
    for m in _TAG.finditer(html):
        slash, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        out.append((m.start(), m.end(), bool(slash), "" if m[1] or not tag else tag.lower(), attributes or ""))
    return out


def _opens(tag: str, attributes: str) -> bool:
    return tag in ("article", "main") or bool(attributes.strip()) and bool(_BODY.search(attributes))


def _wrappers(tags: list[tuple[int, int, bool, str, str]]) -> set[int]:
    """Starts of the elements in which an article begins."""
    known: set[int] = set()
    held = _Open()
    for start, _, slash, tag, attributes in tags:
        if not tag or tag in VOID:
            continue
        if slash:
            held.ended(tag)
            continue
        if _opens(tag, attributes):
            for _, at in reversed(held.stack):
                if at in known:
                    break
                known.add(at)
        held.push(tag, start)
    return known


def segments(html: str | None, trust: bool = True) -> list[tuple[bool, str]]:
    """(open, text) of the segments that aren't gone, in page order; text with character references decoded, not yet stripped. Without trust in markup all are open."""
    held = _Open()  # of each element: its tag, whether it is gone, opens an article, is prose, is in doubt
    found: list[list] = []  # article number or -1, open, pieces of text
    gone = inside = prose = doubt = 0
    article, articles, fresh = -1, 0, True

    def close(tag: str) -> None:
        nonlocal gone, inside, prose, doubt, article
        for _, g, a, p, d in held.ended(tag):
            gone -= g
            prose -= p
            doubt -= d
            if a:
                inside -= 1
                article = article if inside else -1

    def text(s: str) -> None:
        nonlocal fresh
        in_header = held.of("header") and not (article >= 0 and any(held.of(t) for t in HEADINGS))
        if not s or trust and (gone or in_header):
            return
        if not s.strip():
            if not fresh and found:
                found[-1][2].append(" ")
            return
        is_open = not (trust and article >= 0 and prose and not doubt)
        if fresh or not found or found[-1][0] != article or found[-1][1] != is_open:
            found.append([article, is_open, []])
            fresh = False
        found[-1][2].append(unescape(s) if "&" in s else s)

    at, html = 0, html or ""
    tags = _tags(html)
    wrappers = _wrappers(tags)
    for start, end, slash, tag, attributes in tags:
        text(html[at:start])
        at = end
        if not tag:
            continue
        if tag in BLOCKS:
            fresh = True
            if tag != "br" and held.stack and held.stack[-1][0] == "p":
                close("p")
        if tag in VOID:
            continue
        if slash:
            close(tag)
            continue
        opens, is_prose = _opens(tag, attributes), tag in PROSE
        mark = PLAIN if tag in ("html", "body") or opens else _mark(attributes)
        if tag not in BLOCKS and prose and mark < UNSEEN:  # words of a sentence
            mark = PLAIN
        if mark == WEAK and not inside:
            mark = STRONG
        elif mark == STRONG and tag in HEADINGS:
            mark = WEAK
        out = tag in GONE and not (tag == "label" and prose) or mark >= STRONG or tag == "article" and bool(inside) and bool(held.of("article"))
        if out and not inside and start in wrappers:
            out = False
        if is_prose and held.stack and held.stack[-1][0] == tag and tag in ("li", "dd", "dt", "td", "th"):
            close(tag)
        doubtful = mark == WEAK and not out
        held.push(tag, out, opens, is_prose, doubtful)
        gone += out
        prose += is_prose
        doubt += doubtful
        if opens:
            inside += 1
            if not gone and (inside == 1 or tag == "article"):
                article, articles = articles, articles + 1
    text(html[at:])
    if trust and articles:
        size: dict[int, int] = {}
        for a, _, parts in found:
            if a >= 0:
                size[a] = size.get(a, 0) + sum(map(len, parts))
        if size:
            best = max(size, key=lambda a: (size[a], -a))
            found = [x for x in found if x[0] == best]
    return [(o, "".join(parts)) for _, o, parts in found]


def host_of(url: str | None) -> str:
    m = re.match(r"\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "", re.I)
    return m[1].lower() if m else ""


def _open_tokens(parts: list[tuple[bool, str]]) -> list[str]:
    return [w for is_open, s in parts if is_open for w in s.split()]


def stream_of(url: str | None, parts: list[tuple[bool, str]]) -> int:
    """The name of a page's stream: equal for equal hosts and words, sure and open."""
    named = "\0".join([host_of(url), *(w + "\1" if is_open else w for is_open, s in parts for w in s.split())]).encode()
    return int.from_bytes(blake2b(named, digest_size=8).digest(), "little", signed=True)


def _joined(parts: list[tuple[bool, str]], gone: set[int]) -> str:
    out, k = [], 0
    for is_open, s in parts:
        words = s.split()
        if is_open:
            kept = [w for i, w in enumerate(words, k) if i not in gone]
            k += len(words)
            out += kept
        else:
            out += words
    return " ".join(out)


def boilerplate(pages: DataFrame, run: int = RUN, min_pages: int = PAGES) -> DataFrame:
    """(stream, gone) of pages (stream, host, parts): of each stream of open tokens the places that its host's suffix array finds covered."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_open_tokens([(x["o"], x["s"]) for x in parts]) for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], names=["rk", "host", "words"])

    streams = pages.select("stream", "host", "parts").mapInArrow(tokens, "rk long, host string, words array<string>")
    place = streams.select("host", "rk", F.col("rk").alias("ord"), F.posexplode("words").alias("pos", "word"))
    symbols = place.select("rk", "ord", "pos", F.xxhash64("host", "word").alias("a"), F.xxhash64(F.lit(17), "host", "word").alias("b"))
    first = doubling.first_ranks(symbols, ["a", "b"])
    ranks = doubling.at_length(first, run)
    counted = ranks.groupBy("r", "rk").agg(F.count(F.lit(1)).alias("_n")).groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("_n"))
    spread = materialise(counted.where(F.col("n") >= min_pages))
    covered = join_hot(ranks, spread, ["r"], "_n").select("rk", F.explode(F.sequence("pos", F.col("pos") + run - 1)).alias("pos"))
    out = materialise(covered.groupBy(F.col("rk").alias("stream")).agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    discard(first, ranks, spread)
    return out


def html_extract(pages: DataFrame, run: int = RUN, min_pages: int = PAGES, url_col: str = "url", html_col: str = "html", keep_html: bool = True, trust: bool = True) -> DataFrame:
    """pages with text, the main text, and n_chars, its code points."""
    outputs = [("text", T.StringType()), ("n_chars", T.LongType())]
    own = fresh(pages)
    held, stream, host, gone = f"{own}parts", f"{own}stream", f"{own}host", f"{own}gone"
    added = [(held, T.ArrayType(T.StructType([T.StructField("o", T.BooleanType()), T.StructField("s", T.StringType())]))), (stream, T.LongType()), (host, T.StringType())]
    kept, schema = with_columns_schema(pages, ["text", "n_chars"], [*added, *outputs])
    if not keep_html:
        schema = T.StructType([f for f in schema.fields if f.name != html_col])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("o", pa.bool_()), ("s", pa.string())]))
        for batch in batches:
            for a in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(a, 512)
                rows = []
                for url, html in zip(part.column(url_col).to_pylist(), part.column(html_col).to_pylist(), strict=True):
                    parts = segments(html, trust)
                    if _open_tokens(parts):
                        rows.append(([{"o": o, "s": s} for o, s in parts], stream_of(url, parts), host_of(url), None, None))
                    else:
                        text = _joined(parts, set())
                        rows.append((None, None, None, text, len(text)))
                values = list(zip(*rows, strict=True)) or [[]] * 5
                types = [kind, pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = {n: pa.array(v, t) for (n, _), v, t in zip([*added, *outputs], values, types, strict=True)}
                yield append(part if keep_html else part.drop_columns([html_col]), columns)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_joined([(x["o"], x["s"]) for x in parts], set(places or ())) for parts, places in zip(batch.column(held).to_pylist(), batch.column(gone).to_pylist(), strict=True)]
            yield append(batch.drop_columns([held, gone]), {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    parsed = materialise(map_in_arrow(kept, parse, schema))
    columns = [F.col(f"`{f.name}`") for f in schema.fields if f.name not in (held, stream, host)]
    done = parsed.where(F.col(held).isNull()).select(*columns)
    left = parsed.where(F.col(held).isNotNull())
    if left.isEmpty():
        return done
    marks = boilerplate(left.select(F.col(stream).alias("stream"), F.col(host).alias("host"), F.col(held).alias("parts")), run, min_pages).withColumnsRenamed({"stream": stream, "gone": gone})
    marked = left.join(F.broadcast(marks) if marks.count() <= SENT_MARKS else marks, stream, "left")
    finished = map_in_arrow(marked.select(*columns[:-2], held, gone), finish, T.StructType([f for f in schema.fields if f.name not in (held, stream, host)]))
    return done.unionByName(finished)
