"""HTML extraction by equivalence-class template deduction.

A page is read as tokens: opened and closed elements, told apart by their path, and text blocks, told apart by path
and text. Over the pages of a host, tokens with the same occurrence vector (how often on which page) form an
equivalence class; the vector is summed up in a fingerprint, so Spark groups tokens by aggregation and no host's pages
meet in a task. A large and frequent class is valid if its tokens follow each other in one order on the pages that
have it, and nests in one gap of one other class (or in none): the class of tokens that occur once on every page is the
skeleton, list items and optional parts lie in its gaps. Pages vote on order and gap, each by a hash, and Spark counts
the votes. The valid classes are the host's template; what lies between its tokens are slots. The main text is the text
of the slots, so a block that the template itself holds goes, in an article too. Where templates would take half or more
of the text of a host's articles, the pages are copies of an article rather than instances of a template, and
text in articles stays.

The names of elements, classes, ids and roles break ties that repetition cannot: text that varies from page to page, but
is page furniture. If the page has an article or main element, only slots within are main text. Names that are also
words of content (AMBIGUOUS, in a compound) mark furniture in an article only where the template has the element.

Blocks are runs of text between block-level tags, with character references decoded and white space (a br too) as one
space.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.plans.shared import bound_batches, discard, join_checked, materialise

#: A class is valid on a host if at least so many pages, and this share of them, have its tokens.
LEAST_PAGES, LEAST_SHARE = 3, 0.5
#: Tokens of a valid class at least.
LEAST_TOKENS = 2
#: A class is valid if this share of the pages that have it agree on its order and gap.
AGREEING = 0.9
#: From this share of the articles' text on, a template is taken for copies of one article.
MOST_OF_ARTICLES = 0.5

#: Elements without content, with raw content, that break a block, and of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("head nav footer aside form script style noscript template menu button select option textarea input iframe object embed svg math canvas audio video dialog title noembed noframes datalist".split())
MAIN = frozenset("article main".split())
#: Words of class, id or role that mark furniture, in whole and as beginnings.
MARKS = frozenset("ad ads adv nav navbar menu header masthead footer sidebar side aside notice notices cookie cookies consent gdpr banner promo popup modal overlay share sharing social related recommended comments comment commentlist respond disqus subscribe newsletter breadcrumb breadcrumbs pagination pager toolbar search login signup alert widget skip".split())
MARK_STARTS = ("advert", "sponsor", "comment", "cookie", "newsletter", "breadcrumb", "sidebar", "navigation", "reader-comment")
#: Compound names that mark furniture within an article as well.
COMPOUNDS = frozenset("ad-slot ad-box ad-banner ad-unit ad-container ad-wrapper google-ad text-ad reader-comments reader-comment comment-list comment-section comments-section comments-area comment-form user-comments cookie-banner cookie-notice cookie-consent newsletter-signup social-share share-buttons related-articles related-posts".split())
AMBIGUOUS = frozenset("menu header side aside notice notices share sharing social related recommended respond search login signup alert widget skip toolbar popup modal overlay footer".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+>|[^>]*>)""", re.S)
_TAG_START = re.compile(r"<[a-zA-Z/!?]").match
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: Opening one of these closes an open element of the same set, up to the nearest element that bounds it.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) >> 1


def _marked(words: str) -> tuple[bool, bool, bool]:
    """Whether class, id and so on mark furniture: by a whole name, by a part of a compound, by an ambiguous part."""
    names = words.lower().split()
    parts = [w for name in names for w in re.split(r"[_-]+", name) if w]
    whole = any(w in MARKS or w in COMPOUNDS or (w.startswith(MARK_STARTS) and w.isalpha()) for w in names)
    part = any((w in MARKS and w not in AMBIGUOUS) or w.startswith(MARK_STARTS) for w in (*names, *parts))
    return whole, part, any(w in AMBIGUOUS for w in parts)


class Block(NamedTuple):
    """A text block: surely furniture, in an ambiguously named element outside an article, in an article, and the
    tokens of such elements within the article."""

    text: str
    furniture: bool
    perhaps: bool
    main: bool
    doubts: tuple[int, ...]


class Page:
    """Tokens of a page in order: (hash, None) of an element, (hash, block) of a text block."""

    def __init__(self, source: str | None):
        self.tokens: list[tuple[int, Block | None]] = []
        self._stack: list[tuple] = [("", 0, False, False, False, ())]  # name, path, and a block's flags
        self._pieces: list[str] = []
        self._read(source or "")

    def _flush(self) -> None:
        text = " ".join("".join(self._pieces).split())
        self._pieces.clear()
        if text:
            self.tokens.append((_hash(f"{self._block[1]}#{text}"), Block(text, *self._block[2:])))

    def _text(self, text: str) -> None:
        if text:
            top = self._stack[-1]
            if self._pieces and top[2] and not self._block[2]:  # a control within a line of text does not cut it
                return
            if not self._pieces or top[2:] != self._block[2:]:
                self._flush()
                self._block = top
            self._pieces.append(text)

    def _pop_to(self, depth: int) -> None:
        for name, path, *_ in reversed(self._stack[depth:]):
            self.tokens.append((_hash(f"{path}/"), None))
            if name in BLOCKS:
                self._flush_before()
        del self._stack[depth:]

    def _flush_before(self) -> None:
        """End the block before the token that was just added."""
        if self._pieces:
            token = self.tokens.pop()
            self._flush()
            self.tokens.append(token)

    def _open(self, name: str, rest: str) -> None:
        if name in BLOCKS:
            self._flush()
            for depth in range(len(self._stack) - 1, 0, -1):  # a block ends an open paragraph
                if self._stack[depth][0] == "p":
                    self._pop_to(depth)
                    break
                if self._stack[depth][0] in BLOCKS:
                    break
        if name in _SIBLINGS:
            ends, bounds = _SIBLINGS[name]
            for depth in range(len(self._stack) - 1, 0, -1):
                if self._stack[depth][0] in bounds:
                    break
                if self._stack[depth][0] in ends:
                    self._pop_to(depth)
                    break
        _, path, furniture, perhaps, main, doubts = self._stack[-1]
        marks, hidden, role = "", False, ""
        if len(rest) > 1:
            for key, a, b, c in _ATTRIBUTE.findall(rest):
                key, value = key.lower(), a or b or c
                marks = f"{marks} {value}" if key in ("class", "id") else marks
                role = value.lower() if key == "role" else role
                hidden |= key == "hidden" or (key == "aria-hidden" and value.lower() == "true")
        path = _hash(f"{path:x}/{name}{'.' + ' '.join(sorted(marks.split())) if marks else ''}")
        self.tokens.append((path, None))
        if name in VOID:
            return
        furniture = furniture or name in FURNITURE or (name == "header" and not main) or hidden or role in ROLES
        if name in MAIN or role == "main":
            main, perhaps = True, False
        if marks and name not in ("html", "body", "article", "main"):
            whole, part, ambiguous = _marked(marks)
            furniture = furniture or whole or (part and not main)
            if main and (part or ambiguous) and not whole:
                doubts = (*doubts, path)  # the template decides
            perhaps = perhaps or (ambiguous and not main)
        self._stack.append((name, path, furniture, perhaps, main, doubts))

    def _close(self, name: str) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            if self._stack[depth][0] == name:
                self._pop_to(depth)
                return
        if name in BLOCKS:
            self._flush()

    def _read(self, source: str) -> None:
        at, size, last = 0, len(source), source.rfind(">")
        self._block = self._stack[0]
        while at < size:
            tag = source.find("<", at)
            if tag < 0:
                tag = size
            if tag > at:
                self._text(html_lib.unescape(source[at:tag]))
            if tag == size or tag > last and _TAG_START(source, tag):  # the page ends within a tag
                break
            m = _TAG.match(source, tag)
            if not m:
                self._text("<")
                at = tag + 1
                continue
            at = m.end()
            if m["cdata"]:
                self._text(m["cdata"])
            elif m["name"]:
                name = m["name"].lower()
                if m["close"]:
                    self._close(name)
                elif name == "br":
                    self._text(" ")
                    self._open(name, m["rest"])
                else:
                    self._open(name, m["rest"])
                    if name in RAW and not m["rest"].endswith("/>"):
                        end = _RAW_END[name].search(source, at)
                        at = end.start() if end else size
        self._pop_to(1)
        self._flush()

    def slots(self, template: set[int], within: bool = True) -> Iterator[tuple[Block, bool]]:
        """The blocks in the template's gaps, and whether they are furniture; articles have gaps only if ``within``."""
        for token, block in self.tokens:
            if block and (token not in template or block.main and not within):
                yield block, block.furniture or block.perhaps or any(x in template for x in block.doubts)

    def main_text(self, template: set[int], within: bool = True) -> str:
        has_main = any(block and block.main for _, block in self.tokens)
        return "\n".join(block.text for block, furniture in self.slots(template, within) if not furniture and (block.main or not has_main))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def tokens_of(pages: DataFrame) -> DataFrame:
    """host, page, tokens, chars: a page's tokens in order, and the length of those that are text of its article."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            pages = [Page(source).tokens for source in batch["html"]]
            chars = [[len(b.text) if b and b.main and not b.furniture else 0 for _, b in tokens] for tokens in pages]
            yield pd.DataFrame({"host": batch["host"], "page": batch["page"], "tokens": [[t for t, _ in tokens] for tokens in pages], "chars": chars})

    return pages.mapInPandas(run, "host string, page string, tokens array<long>, chars array<int>")


def equivalence_classes(tokens: DataFrame) -> DataFrame:
    """host, token, pages, low, high: every token of a host with its support and the fingerprint of its occurrence vector.

    The fingerprint is two sums of a hash of (page, occurrences): equal vectors have equal sums, in whatever order
    pages come, and tasks sum their own pages first.
    """

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            for host, page, own in zip(batch["host"], batch["page"], batch["tokens"], strict=True):
                for token, n in Counter(own.tolist()).items():
                    h = _hash(f"{page}:{n}")
                    total = sums.setdefault((host, token), [0, 0, 0])
                    total[0] += 1
                    total[1] += h & 0x7FFFFFFF
                    total[2] += h >> 32
            yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["host", "token", "pages", "low", "high"])

    counted = tokens.select("host", "page", "tokens").mapInPandas(run, "host string, token long, pages long, low long, high long")
    return counted.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "low", "high")))


def candidates(tokens: DataFrame) -> DataFrame:
    """host, members (token, class): the large and frequent classes of a host; at most 1 / LEAST_SHARE times a page's tokens."""
    total = tokens.groupBy("host").agg(F.count("*").alias("total"))
    frequent = equivalence_classes(tokens).join(total, "host")
    frequent = frequent.where((F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= F.col("total") * LEAST_SHARE))
    classes = frequent.groupBy("host", "pages", "low", "high").agg(F.collect_list("token").alias("own")).where(F.size("own") >= LEAST_TOKENS)
    name = F.shiftrightunsigned(F.xxhash64("pages", "low", "high"), 1)
    return classes.select("host", F.transform("own", lambda t: F.struct(t.alias("token"), name.alias("cls"))).alias("own")).groupBy("host").agg(F.flatten(F.collect_list("own")).alias("members"))


def forms(tokens: list[int], classes: dict[int, int]) -> dict[int, int]:
    """class -> hash of its order and of the gap it lies in on this page; 0 if it has no one order, or several gaps.

    A repeat of a class is open from its first token to its last; what opens meanwhile lies in its current gap. A class
    whose repeat is open when an outer one goes on does not nest.
    """
    found: dict[int, list[int]] = {}
    for t in tokens:
        if t in classes:
            found.setdefault(classes[t], []).append(t)
    order: dict[int, dict[int, int]] = {}
    for c, own in found.items():
        first = list(dict.fromkeys(own))
        order[c] = {t: i for i, t in enumerate(first)} if own == first * (len(own) // len(first)) else {}
    broken = {c for c in found if not order[c]}
    gaps: dict[int, set[tuple[int, int]]] = {c: set() for c in found}
    stack: list[list[int]] = []  # class, place in its order
    for t in tokens:
        c = classes.get(t)
        if c is None or c in broken:
            continue
        place = order[c][t]
        if place:
            while stack and stack[-1][0] != c:
                broken.add(stack.pop()[0])
            if not stack:
                broken.add(c)
                continue
            stack[-1][1] = place
        else:
            gaps[c].add((stack[-1][0], stack[-1][1]) if stack else (0, 0))
            stack.append([c, 0])
        if place == len(order[c]) - 1:
            stack.pop()
    return {c: 0 if c in broken or len(gaps[c]) > 1 else _hash(f"{list(order[c])}{gaps[c]}") for c in found}


def votes(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """host, cls, form, pages, covered: the pages of each form of a class, and the article text that it covers.

    Rows of class 0 hold the text of all articles.
    """

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            sums: dict[tuple[str, int, int], list[int]] = {}
            classes: dict[str, dict[int, int]] = {}
            for host, own, chars, members in zip(batch["host"], batch["tokens"], batch["chars"], batch["members"], strict=True):
                if host not in classes:
                    classes[host] = {m["token"]: m["cls"] for m in members}
                own = own.tolist()
                covered: Counter = Counter()
                for token, n in zip(own, chars.tolist(), strict=True):
                    if n:
                        covered[0] += n
                        covered[classes[host].get(token, -1)] += n
                for c, form in (*forms(own, classes[host]).items(), (0, 0)):
                    total = sums.setdefault((host, c, form), [0, 0])
                    total[0] += 1
                    total[1] += covered[c]
            yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["host", "cls", "form", "pages", "covered"])

    joined = join_checked(tokens.select("host", "tokens", "chars"), known, "host")
    counted = joined.mapInPandas(run, "host string, cls long, form long, pages long, covered long")
    return counted.groupBy("host", "cls", "form").agg(F.sum("pages").alias("pages"), F.sum("covered").alias("covered"))


def templates(pages: DataFrame) -> DataFrame:
    """host, template, within: the tokens of each host's valid classes, and whether they apply in articles too."""
    tokens = materialise(tokens_of(pages), "page-tokens")
    known = materialise(candidates(tokens), "page-classes")
    voted = votes(tokens, known)
    agreed = voted.groupBy("host", "cls").agg(F.sum("pages").alias("pages"), F.max(F.when(F.col("form") != 0, F.col("pages"))).alias("agreeing"), F.sum("covered").alias("covered"))
    valid = (F.col("cls") != 0) & (F.col("agreeing") >= F.col("pages") * AGREEING)
    hosts = agreed.groupBy("host").agg(
        F.collect_list(F.when(valid, F.col("cls"))).alias("valid"),
        (F.coalesce(F.sum(F.when(valid, F.col("covered"))), F.lit(0)) < F.lit(MOST_OF_ARTICLES) * F.greatest(F.max(F.when(F.col("cls") == 0, F.col("covered"))), F.lit(1))).alias("within"),
    )
    found = known.join(hosts, "host").select("host", F.transform(F.filter("members", lambda m: F.array_contains("valid", m["cls"])), lambda m: m["token"]).alias("template"), "within")
    out = materialise(found.where(F.size("template") > 0), "templates")
    discard(tokens, known)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of (page_id, url, html).

    Null and empty pages give an empty text. Pages without a host share one group; hosts of fewer than LEAST_PAGES
    distinct pages have an empty template, and the names alone decide. Rows of a host with the same html count as one
    page for the template, as copies do not tell it from text, and give the same text; very long pages are read whole;
    further columns are not read; an empty table gives an empty result.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    bodies = rows.select("host", "html").distinct().withColumn("page", F.sha2("html", 256))
    found = templates(bodies)

    @F.pandas_udf("string")
    def main_text(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, known, cuts in batches:
            sets: dict[bytes, set[int]] = {}
            out = []
            for source, template, within in zip(sources, known, cuts, strict=True):
                key = b"" if template is None else template.tobytes()
                if key not in sets:
                    sets[key] = set() if template is None else set(template.tolist())
                out.append(Page(source).main_text(sets[key], bool(within)))
            yield pd.Series(out, dtype=object)

    joined = join_checked(rows, found, "host", "left")
    return joined.select("page_id", "url", main_text("html", "template", "within").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op2_html_text": op2_html_text}
#: No SQL: pages are parsed; tests compare with texts known beforehand.
ORACLE: dict[str, str] = {}
