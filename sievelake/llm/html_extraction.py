"""Main text of web pages by consensus of a host's pages.

Every page is read into a tree, and its containers are scored by the text that stands in them outside links and boilerplate. Each
page votes for the generalised paths of its best containers (tags and classes from the root, numbers of three digits and hashes in
names written alike), weighted by score. The votes are summed by host and path in Spark, and the path with most votes wins. Then every page is
extracted again: the containers on the winning path where the page has text there, its own best container elsewhere, without
navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments of readers.

A page's text is its blocks in order, joined by a line break; white space inside a block, br too, is one space. Nothing else is
dropped or cut.

Defined results: a null or blank html, and one without text, gives the empty text; a page without a host in its url goes by its own
best container; ties of votes go to the smaller path; broken markup (unclosed, crossed or cut tags) is read as far as it goes;
repeated rows are pages each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import batches, written

#: Fixed values, from the HTML standard: elements without content, elements whose content is not markup, elements that are no text
#: of a page, elements that begin and end a block.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
SILENT = RAW | frozenset("applet audio button canvas datalist head map meter noscript object option progress select svg template video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
#: What an opening tag ends, and what it does not look beyond.
SECTIONS = frozenset("article aside body caption footer form header html main nav section table td th".split())
LISTS = frozenset("dir dl menu ol ul".split()) | SECTIONS
ENDS = {"li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, LISTS), "dd": ({"dt", "dd"}, LISTS)}
ENDS |= {"tr": ({"tr", "td", "th"}, frozenset({"table"})), "td": ({"td", "th"}, frozenset({"tr", "table"})), "th": ({"td", "th"}, frozenset({"tr", "table"}))}
ENDS |= {x: ({"thead", "tbody", "tfoot", "tr", "td", "th"}, frozenset({"table"})) for x in ("thead", "tbody", "tfoot")}
SCOPE = frozenset("caption html table td template th".split())

#: What boilerplate is called: tags, roles, words in the names of classes and ids. A name with one of OWN is the article's own header;
#: a word after one of TURNS says what an element has around it, not what it is.
BOILERPLATE = frozenset("aside dialog footer form menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising adbox adslot alert alerts aside banner banners breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright disclaimer discussion disqus feedback footer gdpr legal login masthead menu menubar menus modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination paywall popup promo promos promoted promotion promotions recommendations recommended related replies reply respond search share sharing sidebar sidebars sidenav signup skip social sponsor sponsored sponsors subscribe subscription toc toolbar topbar trending widget widgets".split()
)
HEADERS = frozenset({"header", "headers"})
OWN = frozenset("article articles blog content entry main post story text".split())
TURNS = frozenset("has have hide no non not with without".split())
CONTAINER = frozenset("article blockquote body center dd details div main section td".split())

TAG = re.compile(r"<!--.*?-->|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(>|\Z)", re.S)
NAMES = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}
CHANGING = re.compile(r"(?=[a-f]*\d)[0-9a-f]{8,}|\d{3,}")
#: Characters from which a block counts in full; what a container counts of those within it; paths that a page votes for; a whole vote.
LONG, SHARE, VOTES, UNIT = 25, 0.6, 3, 1000


def noisy(names: str) -> bool:
    """Whether a class, an id or a role says boilerplate."""
    for name in names.split():
        words = [w.lower() for w in WORD.findall(name)]
        own = not OWN.isdisjoint(words)
        for before, word in zip(["", *words], words, strict=False):
            if before not in TURNS and (word in NOISE or word in HEADERS and not own):
                return True
    return False


class Page:
    """A page as lists by element, parents before children: tag, parent, names, whether it is boilerplate, its nearest block."""

    def __init__(self, source: str):
        self.tags, self.parents, self.classes, self.marked = ["html"], [-1], [""], [False]
        self.owner, self.silent, self.link = [0], [False], [False]
        self.pieces: list[tuple[int, str | None]] = []  # (element, text); None ends a block
        self._read(source)
        self.noise = self._noise()
        self.blocks = list(self._blocks())
        self.length = [0] * len(self.tags)
        for owner, text, _ in self.blocks:
            self.length[owner] += len(text)
        for i in range(len(self.tags) - 1, 0, -1):
            self.length[self.parents[i]] += self.length[i]

    def _read(self, source: str) -> None:
        now, at = 0, 0
        tags, parents, pieces = self.tags, self.parents, self.pieces
        while m := TAG.search(source, at):
            if m.start() > at:
                pieces.append((now, html.unescape(source[at : m.start()])))
            at = m.end()
            if m[2] is None:
                continue
            if not m[4]:
                return  # a tag that the page's end cuts off
            tag = m[2].lower()
            if tag in BLOCK:
                pieces.append((now, None))
            if m[1]:
                if tag not in ("html", "body"):
                    now = self._closed(now, tag)
                continue
            if tag == "br":
                pieces.append((now, " "))
                continue
            if tag == "html" or tag in VOID:
                continue
            now = self._ended(now, tag)
            classes, mark = "", False
            for kind, *values in NAMES.findall(m[3]) if "=" in m[3] else ():
                value = html.unescape("".join(values))
                if kind.lower() == "class":
                    classes = value
                if tag not in ("html", "body", "article", "main") and (value.lower() in ROLES if kind.lower() == "role" else noisy(value)):
                    mark = True
            i = len(tags)
            self.owner.append(i if tag in BLOCK else self.owner[now])
            self.silent.append(tag in SILENT or self.silent[now])
            self.link.append(tag == "a" or self.link[now])
            tags.append(tag)
            parents.append(now)
            self.classes.append(classes)
            self.marked.append(mark)
            if tag in RAW:
                end = RAW_END[tag].search(source, at)
                at = end.start() if end else len(source)
            now = i
        if at < len(source):
            pieces.append((now, html.unescape(source[at:])))

    def _ended(self, now: int, tag: str) -> int:
        """Where an element of this tag begins: what it ends without a closing tag is left."""
        if tag in BLOCK and self.tags[self.owner[now]] == "p":
            now = self.parents[self.owner[now]]
        if tag in ENDS:
            ends, walls = ENDS[tag]
            at = self.owner[now]
            while at and self.tags[at] not in walls:
                up = self.parents[at]
                if self.tags[at] in ends:
                    now = up
                at = self.owner[up]
        return now

    def _closed(self, now: int, tag: str) -> int:
        """Where text stands after a closing tag; one that closes nothing is passed over."""
        walls = SCOPE if tag in BLOCK else BLOCK
        at = now
        while at and self.tags[at] != tag:
            if self.tags[at] in walls and not (tag in ("table", "thead", "tbody", "tfoot", "tr") and self.tags[at] != "table"):
                return now
            at = self.parents[at]
        return self.parents[at] if at else now

    def _noise(self) -> list[bool]:
        """Whether each element is boilerplate or within such. What stands around the only headline or article of a page is not."""
        headed = {j for i, t in enumerate(self.tags) if t == "h1" for j in self.line(i) if self.tags[j] == "header"}
        within, plain = [False], [False]
        for i in range(1, len(self.tags)):
            tag, up = self.tags[i], self.parents[i]
            within.append(within[up] or tag in ("article", "main"))  # a header in there with the headline is the article's own
            plain.append(tag in BOILERPLATE or self.marked[i] or tag == "header" and not (within[i] and i in headed))

        def spread() -> list[bool]:
            out = [False]
            for i in range(1, len(self.tags)):
                out.append(plain[i] or out[self.parents[i]])
            return out

        noise = spread()
        heads = [i for i, t in enumerate(self.tags) if t in ("article", "main", "h1") and not self.silent[i]]
        if heads and all(noise[i] for i in heads):
            for i in {j for head in heads for j in self.line(head)} - {0}:
                if self.tags[i] == "form" or self.marked[i] and self.tags[i] not in BOILERPLATE:
                    plain[i] = False
            noise = spread()
        return noise

    def _blocks(self) -> Iterator[tuple[int, str, int]]:
        """(nearest block element, text, characters of links) of what is no boilerplate, in order."""
        texts: list[str] = []
        owner, links = 0, 0
        for i, text in [*self.pieces, (0, None)]:
            if text is None:
                if texts and (whole := " ".join("".join(texts).split())):
                    yield owner, whole, min(links, len(whole))
                texts, links = [], 0
            elif not (self.silent[i] or self.noise[i]):
                if not texts:
                    owner = self.owner[i]
                texts.append(text)
                links += len(text) if self.link[i] else 0

    def scores(self) -> dict[int, float]:
        """What each container holds: blocks of its own in full, those of containers within it in part. Links and short blocks count little."""
        out: dict[int, float] = {}
        for owner, text, links in self.blocks:
            weight = float(len(text) - 2 * links)
            if weight <= 0:
                continue
            if len(text) < LONG and text[-1] not in ".!?。！？…":
                weight /= 4
            at = owner
            while at >= 0:
                if self.tags[at] in CONTAINER or at == 0:
                    out[at] = out.get(at, 0.0) + weight
                    weight *= SHARE
                    if weight < 0.5:
                        break
                at = self.parents[at]
        return out

    def best(self, scores: dict[int, float]) -> int:
        """The container of the article: that of most text, or the element around it that adds a headline and little else."""
        found = min(scores, key=lambda i: (-scores[i], i))
        up = found
        while up > 0:
            if self.tags[up] == "article":
                return up
            up = self.parents[up]
        inside = self.length[found]
        for head in (i for i, t in enumerate(self.tags) if t == "h1" and not self.noise[i] and not self.silent[i]):
            line = set(self.line(found))
            meet = next(i for i in self.line(head) if i in line)
            if meet != found and self.length[meet] - inside <= self.length[head] + inside / 4:
                return meet
        return found

    def line(self, i: int) -> Iterator[int]:
        while i >= 0:
            yield i
            i = self.parents[i]

    def step(self, i: int) -> str:
        """Tag and classes, with what changes from page to page written as #."""
        return ".".join([self.tags[i], *sorted({CHANGING.sub("#", c.lower()) for c in self.classes[i].split()})])

    def path(self, i: int) -> str:
        return ">".join(reversed([self.step(j) for j in self.line(i)]))

    def votes(self) -> Iterator[tuple[str, int]]:
        """Paths of the best containers with their shares of a vote."""
        scores = self.scores()
        if not scores:
            return
        first = self.best(scores)
        most = max(scores.values())
        yield self.path(first), UNIT
        others = sorted((i for i in scores if i != first), key=lambda i: (-scores[i], i))[: VOTES - 1]
        for path, share in {self.path(i): int(UNIT / 2 * scores[i] / most) for i in reversed(others)}.items():
            yield path, share

    def text(self, consensus: str | None) -> str:
        if not self.blocks:
            return ""
        if consensus:
            last = consensus.rpartition(">")[2]
            tag = last.partition(".")[0]
            own = self._under({i for i, t in enumerate(self.tags) if t == tag and self.length[i] and self.step(i) == last and self.path(i) == consensus})
            if own:
                return "\n".join(own)
        scores = self.scores()
        return "\n".join(self._under({self.best(scores)})) if scores else ""

    def _under(self, chosen: set[int]) -> list[str]:
        if not chosen:
            return []
        inside = [False] * len(self.tags)
        for i in range(len(self.tags)):
            inside[i] = i in chosen or i > 0 and inside[self.parents[i]]
        return [text for owner, text, _ in self.blocks if inside[owner]]


HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


def consensus(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """host, path, votes: the winning path of each host."""
    batches(pages.sparkSession)

    def vote(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            sums: Counter = Counter()
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, share in Page(source).votes():
                    sums[host, path] += share
            hosts, paths = zip(*sums, strict=True) if sums else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(sums.values(), pa.int64())], ["host", "path", "votes"])

    own = pages.select(host_of(url_column), F.col(f"`{html_column}`").alias("html")).where("host <> '' and html is not null")
    sums = own.mapInArrow(vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    best = sums.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("less"), F.col("path"))).alias("first"))
    return best.select("host", "first.path", (-F.col("first.less")).alias("votes"))


def host_of(url_column: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url_column}`"), HOST, 1), F.lit(""))).alias("host")


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """id, url, text, n_chars for every page.

    The winners, a row for each host, are written first, so Spark knows their size when it chooses how to join: it broadcasts
    them only below its threshold, and else splits a host that has many pages.
    """
    winners = written(consensus(pages, url_column, html_column), "html-consensus")
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_column, url_column)]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = [Page(source or "").text(path) for source, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["id", "url", "text", "n_chars"])

    own = pages.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{url_column}`").alias("url"), F.col(f"`{html_column}`").alias("html"), host_of(url_column))
    joined = own.join(winners.select("host", "path"), "host", "left").select("id", "url", "html", "path")
    return joined.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"id": id_column, "url": url_column})
