"""Main text of web pages by the template of their host.

The tokens of a page are its block elements, each with the path of elements above it, and its blocks of text. Elements are
valid if enough pages of the host hold them and each stands inside a valid one; nested into each other they are the
template. Equivalence classes of elements are not formed: a token's occurrence vector, how often it stands in each page,
only tells which texts stand in every page of a slot. Fixed lists of names decide what is left out. The template's slots are what the pages put between its tokens. The slot of the article is
the element that says so (``article``, ``main``) or holds most of the text, and what is left of a page's text there is
extracted: menus, adverts, forms, comments and the like are left out by their elements and names, and a text that is part
of the template itself, once in every page that holds the slot, by its class (headings stay). Inside a named slot that
takes more: the element around the text must be in that class too and hold template texts only, so a sentence that many
articles share among their own paragraphs stays. Pages of a host with one content are one page here, so copies of an
article are no template.

Vectors are compared by sums of page hashes, so no task gathers the pages of a host: each task adds up its own pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.llm.shared import given
from timeline_lake.session import cut_lineage

LEAST_SHARE = 0.3
LITTLE = 4
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr br".split()
)
# Elements whose start ends an open element of the second kind.
CLOSES = {
    **dict.fromkeys(
        "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
        "ol p pre section table ul".split(),
        ("p",),
    ),
    "li": ("li", "p"),
    "dt": ("dt", "dd", "p"),
    "dd": ("dt", "dd", "p"),
    "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"),
    "th": ("td", "th", "p"),
    "thead": ("p",),
    "tbody": ("thead", "tbody", "tr", "td", "th", "p"),
    "tfoot": ("tbody", "tr", "td", "th", "p"),
    "option": ("option",),
}
STOPS = frozenset("html body article section div ul ol dl table td th main nav header footer aside form blockquote figure fieldset".split())
# What is never part of an article, by element and by words of class, id and role.
LEFT_OUT = frozenset(
    "head nav footer aside form script style noscript template iframe object svg button select option textarea input dialog menu title noframes "
    "noembed canvas audio video map".split()
)
LEFT_OUT_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer contentinfo sidebar aside complementary widget ad ads advert adverts advertisement "
    "sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended comment comments commentlist disqus respond reply replies pagination pager toolbar search "
    "form skip".split()
)
# Words that say nothing about what an element holds.
NEUTRAL_WORDS = frozenset(
    "area articles bar block bottom box button buttons column container count group header heading holder icon icons inner item items label left link "
    "links list outer panel posts right row section stories title top wrap wrapper".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
ARTICLE_WORDS = frozenset("article articlebody post story entry".split())
CONTENT_WORDS = frozenset("content main body text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_NAMING = re.compile(r"\b(?:class|id|role|itemprop|hidden|aria-hidden|style)\b", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def label(name: str, attributes: str) -> str:
    """An element as a part of a path: its name and the words of its class, id and role, digits left out."""
    if not attributes or not _NAMING.search(attributes):
        return name
    values = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
    words = sorted({w.lower() for a in ("class", "id", "role", "itemprop") for w in _WORDS.findall(html.unescape(values.get(a, "")))})
    style = values.get("style", "").replace(" ", "").lower()
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in style:
        words.append("!hidden")
    return name + "".join("." + w for w in words)


def parsed(source: str) -> tuple[Counter, list[tuple[str, str]]]:
    """(how often each path of block elements occurs, the blocks of text in order as (path, text)).

    Elements that are left open end where HTML ends them; end tags without an open element are skipped.
    """
    paths: Counter = Counter({"": 1})
    blocks: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    run: list[str] = []

    def here() -> str:
        return stack[-1][1] if stack else ""

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                blocks.append((here(), text))

    def close(to: int) -> None:
        if len(stack) > to:
            flush()
            del stack[to:]

    at = 0
    while at < len(source):
        found = _TOKEN.search(source, at)
        if not found:
            run.append(source[at:])
            break
        if found.start() > at:
            run.append(source[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        attributes = found[3] if found[2] else found[6]
        if found[1] or found[4]:
            if name in INLINE:
                continue
            if name == "p" and not any(n == "p" for n, _ in stack):
                flush()
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if name == "p" and stack[i][0] in STOPS:
                    break
            continue
        if name in INLINE:
            if name == "br":
                run.append(" ")
            continue
        ends = CLOSES.get(name, ())
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ends:
                close(i)
            elif stack[i][0] in STOPS:
                break
        flush()
        path = f"{here()}>{label(name, attributes)}"
        paths[path] += 1
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif name not in VOID and not attributes.endswith("/"):
            stack.append((name, path))
    flush()
    return paths, blocks


def left_out(path: str) -> bool:
    """Whether an element on the path is not part of an article.

    Inside an article a name counts only if it says nothing else: ``share-buttons`` is left out, ``search-history`` is not.
    """
    inside = False
    for part in path.split(">")[1:]:
        name, *words = part.split(".")
        if name in LEFT_OUT or "!hidden" in words:
            return True
        if name in ("html", "body", "main"):
            inside |= name == "main"
            continue
        said = set(words)
        if name == "article":
            if said & COMMENT_WORDS:
                return True
            inside = True
            continue
        if said & LEFT_OUT_WORDS and not said & ARTICLE_WORDS and not (inside and said - LEFT_OUT_WORDS - NEUTRAL_WORDS):
            return True
        if not inside and (name == "header" or said & HEADER_WORDS):
            return True
    return False


def article_slots(chars: dict[str, float]) -> list[str]:
    """The paths whose elements hold the article, given the characters of text right inside each path of the template."""
    total: dict[str, float] = dict.fromkeys(chars, 0.0)
    for path, n in chars.items():
        if n and not left_out(path):
            up = path
            while True:
                if up in total:
                    total[up] += n
                if not up:
                    break
                up = up.rpartition(">")[0]

    def said(path: str) -> set[str]:
        return set(path.rpartition(">")[2].split("."))

    open_ = [p for p, n in total.items() if n and not left_out(p)]
    for wanted in (
        lambda p: said(p) & {"article"} or "articlebody" in said(p),
        lambda p: said(p) & {"main"},
        lambda p: said(p) & ARTICLE_WORDS,
        lambda p: said(p) & CONTENT_WORDS and not said(p) & {"html", "body"},
    ):
        named = [p for p in open_ if wanted(p)]
        outer = [p for p in named if not any(p.startswith(q + ">") for q in named)]
        if outer and sum(total[p] for p in outer) * 4 >= total.get("", 0):
            most = max(total[p] for p in outer)
            return sorted(p for p in outer if 4 * total[p] >= most)
    # No name tells: go down while one element holds most of the text.
    at = ""
    while True:
        below = [p for p in open_ if p.rpartition(">")[0] == at and p != at]
        best = max(below, key=lambda p: (total[p], p), default=None)
        if best is None or 10 * total[best] < 7 * total[at] or best.rpartition(">")[2].split(".")[0] in ("p", "h1", "li", "td"):
            return [at]
        at = best


def inside(path: str, slots: list[str]) -> bool:
    return any(path == s or not s or path.startswith(s + ">") for s in slots)


def extract(source: str, slots: list[str] | None, template_texts: frozenset[int] = frozenset()) -> str:
    """The article of one page. A page that has none of the host's slots, or little of its text there, is taken by itself."""
    paths, blocks = parsed(source)
    chars = dict.fromkeys(paths, 0.0)
    for path, text in blocks:
        chars[path] += len(text)

    def held(by: list[str]) -> float:
        return sum(n for p, n in chars.items() if inside(p, by) and not left_out(p))

    own = article_slots(chars)
    # Names that differ from page to page are in no template: the host's slots then hold little of the page's text.
    if not slots or not any(s in paths for s in slots) or LITTLE * held(slots) < held(own):
        slots = own
    return "\n\n".join(t for p, t in blocks if inside(p, slots) and not left_out(p) and not (template_texts and text_token(p, t) in template_texts))


def text_token(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}") >> 1


def home_number(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path) >> 1


def is_named(path: str) -> bool:
    """Whether a slot says itself that it holds the article."""
    name, *words = path.rpartition(">")[2].split(".")
    return name in ("article", "main") or bool({"article", "articlebody", "main"} & set(words) or set(words) & (ARTICLE_WORDS | CONTENT_WORDS))


# --- Spark jobs ------------------------------------------------------------------------------------------------------


def host_of(url: str):
    """Lower-case host of a URL column; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[^:/?#]*:?//(?:[^/?#@]*@)?([^:/?#]*)", 1), F.lit("")))


def occurrences(pages: DataFrame) -> DataFrame:
    """host, token, pages, times, sum_a, sum_b (the vector), chars, home: element paths, and texts as ``#`` and a number.

    ``home`` is the number of the path that a text stands in, or of the path itself.
    """

    def contents(batches):
        for batch in batches:
            found = []
            for source in batch.column(1):
                kept = [t for p, t in parsed(source.as_py() or "")[1] if not left_out(p)]
                found.append(xxhash.xxh3_128_hexdigest("\0".join(kept)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), batch.column(1)], ["host", "content", "html"])

    def rows(batches):
        seen: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for page, host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                paths, blocks = parsed(source.as_py() or "")
                chars: Counter = Counter()
                homes: dict[str, str] = {}
                for path, text in blocks:
                    chars[path] += len(text)
                    if not left_out(path) and path.rpartition(">")[2].split(".")[0] not in HEADINGS:
                        token = f"#{text_token(path, text)}"
                        paths[token] += 1
                        chars[token] += len(text)
                        homes[token] = path
                for token, n in paths.items():
                    mark = xxhash.xxh3_64_intdigest(f"{page}:{n}")
                    row = seen.get((host, token))
                    if row is None:
                        row = seen[host, token] = [0, 0, 0, 0, 0, home_number(homes.get(token, token))]
                    for i, x in enumerate((1, n, mark & 0x3FFFFFFF, mark >> 34, chars[token])):
                        row[i] += x
            if len(seen) > 200_000:
                yield out(seen)
                seen = {}
        yield out(seen)

    def out(seen):
        columns = list(zip(*seen.values())) or [[]] * 6
        keys = list(zip(*seen)) or [[], []]
        return pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), *(pa.array(c, pa.int64()) for c in columns)], names)

    names = ["host", "token", "pages", "times", "sum_a", "sum_b", "chars", "home"]
    named = pages.select(host_of("url").alias("host"), F.col("html").cast("string")).mapInArrow(contents, "host string, content string, html string")
    asked = named.groupBy("host", "content").agg(F.min("html").alias("html")).select("content", "host", "html")
    counted = asked.mapInArrow(rows, "host string, token string, " + ", ".join(f"{n} long" for n in names[2:]))
    return counted.groupBy("host", "token").agg(*[F.sum(n).alias(n) for n in names[2:-1]], F.max("home").alias("home"))


def deduce(tokens: pd.DataFrame) -> tuple[list[str], list[int]]:
    """(article slots, texts of the template) of one host from its frequent tokens with their vectors."""
    vector = ["pages", "times", "sum_a", "sum_b"]
    tokens = tokens.assign(vector=list(zip(*(tokens[c] for c in vector))))
    elements = tokens[~tokens["token"].str.startswith("#")].set_index("token")
    # Valid classes from the outside in: an element nests in its parent's class, which must be valid itself.
    valid = {""}
    for path in sorted(elements.index, key=lambda p: p.count(">")):
        if path and path.rpartition(">")[0] in valid:
            valid.add(path)
    slots = article_slots({p: float(elements.at[p, "chars"]) for p in valid})
    # A text of the template is in the class of a slot that several contents hold, once each.
    texts = tokens[tokens["token"].str.startswith("#")]
    found: set[str] = set()
    for slot in slots:
        if elements.at[slot, "pages"] == elements.at[slot, "times"] > 1:
            vector = elements.at[slot, "vector"]
            mine = texts[texts["vector"] == vector]
            if is_named(slot):
                # In the article itself only if an element of the same class is there for nothing but such texts.
                held = mine.groupby("home")["chars"].sum()
                alone = {home_number(p) for p in valid if p.startswith(slot + ">") and elements.at[p, "vector"] == vector and elements.at[p, "chars"] == held.get(home_number(p))}
                mine = mine[mine["home"].isin(alone)]
            found |= set(mine["token"])
    return slots, [int(t[1:]) for t in sorted(found)]


def templates(pages: DataFrame) -> DataFrame:
    """host, slots, texts. Only tokens in a fair share of a host's pages come together, a few times a page's tokens."""
    counted = cut_lineage(occurrences(pages).filter("pages > 1 or token = ''"))
    totals = counted.filter("token = ''").select("host", F.col("pages").alias("of_pages"))
    frequent = counted.join(totals, "host").filter(F.col("pages") >= F.col("of_pages") * LEAST_SHARE)

    def one_host(tokens: pd.DataFrame) -> pd.DataFrame:
        slots, texts = deduce(tokens)
        return pd.DataFrame({"host": [tokens["host"].iloc[0]], "slots": [slots], "texts": [texts]})

    return cut_lineage(frequent.drop("of_pages").groupBy("host").applyInPandas(one_host, "host string, slots array<string>, texts array<long>"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text. Pages without a URL are one host. A host with one page, or a page that its
    host's template does not fit, is judged by its own elements. Equal rows give equal rows.
    """

    def rows(batches):
        for batch in batches:
            out = []
            for source, slots, texts in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                out.append(extract(source.as_py() or "", slots, frozenset(texts or ())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    asked = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of("url").alias("host"))
    joined = asked.join(templates(pages), "host", "left").select("page_id", "url", "html", "slots", "texts")
    return joined.mapInArrow(rows, "page_id long, url string, text string, n_chars long")


def op8_template_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(given(spark, folder, "pages"))
