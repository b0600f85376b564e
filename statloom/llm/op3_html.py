"""Main text of HTML pages from flat text blocks.

A page is cut into blocks at block-level tags. A block's features are its words
and link density, those of its neighbours, and what its ancestors' tags, roles and
names say. A decision tree, trained by Spark on a small labelled table, says which blocks
belong to the article. The table has pages made here from a fixed seed, and a bounded sample of the
given pages, labelled by their names; half of its rows don't show these names, so that the tree splits by words and
link densities, the block's and its neighbours', first. Pages are
worked on by themselves (a map); the tree goes to the tasks as a few numbers.

Edge cases: columns of the table that are called text or n_chars give way to the
result's; a null or empty page, or one without an article, has empty text; where names say
nothing and the tree finds nothing, blocks that aren't links are the article;
broken markup is read as far as it goes; repeated rows are rows of their own; an
empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .trees import predict, tree_arrays

# Sets of HTML tags and of words in class names, ids and roles.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("script style noscript template svg math iframe object canvas select textarea button option head title audio video".split())
RAW = set("script style textarea title".split())
BOILER_TAGS = set("nav footer aside form menu dialog".split())
MAIN_TAGS = set("article main".split())
BOILER_WORDS = set(
    "nav navigation navbar menu menubar header footer sidebar side aside ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup signin login register comment comments disqus respond reply replies share sharing social related recommended "
    "recommendations breadcrumb breadcrumbs pager pagination search searchform widget widgets toolbar masthead legal copyright disclaimer contentinfo complementary dialog hidden form outbrain taboola discussion".split()
)
MAIN_WORDS = set("article main content post entry story articlebody maincontent".split())
HEADINGS = {f"h{k}" for k in range(1, 7)}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|([^>]*+)(?:>|\Z))""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>]+))?""")
# Starts that end an open paragraph, and elements that keep what is outside of them open.
P_ENDS = HEADINGS | set("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre search section summary table ul".split())
P_SCOPE = set("applet button caption html marquee object table td template th".split())
ENDED = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ENDS = {tag: re.compile(f"</{tag}\\b[^>]*(?:>|\\Z)", re.I) for tag in RAW}

BOILER, MAIN, HEADER, DROP = 1, 2, 4, 8
FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "boiler", "main", "page_has_main", "header", "heading"]


def tag_flags(tag: str, attributes: str) -> int:
    """What an element says of the text in it."""
    flags = BOILER if tag in BOILER_TAGS else MAIN if tag in MAIN_TAGS else HEADER if tag == "header" else DROP if tag in DROPPED else 0
    if attributes:
        said: dict[str, str] = {}
        for name, value in ATTRIBUTE.findall(attributes):
            said.setdefault(name.lower(), value.strip("\"'"))
        for name, value in said.items():
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                flags |= DROP
            elif name in ("class", "id", "role") and tag not in ("html", "body"):
                words = {x.lower() for x in NAME_WORD.findall(value)}
                if words & BOILER_WORDS:
                    flags |= HEADER if words & BOILER_WORDS == {"header"} else BOILER
                if words & MAIN_WORDS:
                    flags |= MAIN
    return flags


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """The texts of a page's blocks, and a row of features for each."""
    texts: list[str] = []
    rows: list[tuple] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    state = {"flags": 0, "heading": False, "links": 0}

    def close() -> None:
        if parts:
            words = "".join(parts).split()
            if words:
                linked = sum(len(x.split()) for x in links)
                texts.append(" ".join(words))
                rows.append((len(words), min(1.0, linked / len(words)), bool(state["flags"] & BOILER), bool(state["flags"] & MAIN), bool(state["flags"] & HEADER), state["heading"]))
            parts.clear()
            links.clear()

    def text(raw: str) -> None:
        if raw and not state["flags"] & DROP:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if state["links"]:
                links.append(raw)

    def ended(names: set[str], stops) -> None:
        """Ends the innermost open element of these names, if none that stops() is open inside it."""
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in names:
                while len(stack) > depth:
                    name, state["flags"] = stack.pop()
                    count[name] -= 1
                return
            if stops(stack[depth][0]):
                return

    at = 0
    while True:
        found = TOKEN.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            close()
        if found[1]:
            if count.get(tag):
                while True:
                    name, before = stack.pop()
                    count[name] -= 1
                    state["flags"] = before
                    if name == tag:
                        break
            state["links"] = count.get("a", 0)
            if tag in HEADINGS:
                state["heading"] = False
            continue
        names = ENDED.get(tag)
        if names and any(count.get(x) for x in names):
            ended(names, lambda x: x not in INLINE and x not in ("address", "div", "p"))
        if tag in P_ENDS and count.get("p"):
            ended({"p"}, P_SCOPE.__contains__)
        if tag not in VOID:
            attributes = found[3] if found[3] is not None else found[4]
            if tag in RAW:
                end = ENDS[tag].search(page, at)
                at = end.end() if end else len(page)
                continue
            if attributes.endswith("/") and tag not in INLINE and tag in DROPPED:
                continue
            stack.append((tag, state["flags"]))
            count[tag] = count.get(tag, 0) + 1
            state["flags"] |= tag_flags(tag, attributes)
        state["links"] = count.get("a", 0)
        if tag in HEADINGS:
            state["heading"] = True
    close()
    return texts, with_neighbours(rows)


def with_neighbours(rows: list[tuple]) -> np.ndarray:
    own = np.array(rows, float).reshape(-1, 6)
    out = np.zeros((len(own), len(FEATURES)))
    if len(own):
        out[:, 0], out[:, 1] = np.minimum(own[:, 0], 100), own[:, 1]
        out[1:, 2], out[1:, 3] = out[:-1, 0], out[:-1, 1]
        out[:-1, 4], out[:-1, 5] = out[1:, 0], out[1:, 1]
        out[:, 6], out[:, 7], out[:, 9], out[:, 10] = own[:, 2], own[:, 3], own[:, 4], own[:, 5]
        out[:, 8] = own[:, 3].any()
    return out


def labelled_pages(pages: int = 400, seed: int = 7) -> Iterator[tuple[str, set[str]]]:
    """Made pages and the texts of their article blocks."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(draw.randint(a, b)))
    linked = lambda n: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(n))

    def plain() -> str:
        """Menus, link lines and notes that no name tells from the article."""
        kind = draw.randrange(4)
        if kind == 0:
            return f"<div><ul>{linked(draw.randint(2, 8))}</ul></div>"
        if kind == 1:
            return "<p>" + " | ".join(f'<a href="/{word()}">{words(1, 4)}</a>' for _ in range(draw.randint(2, 9))) + "</p>"
        if kind == 2:
            return f'<div><p><a href="/{word()}">{words(4, 25)}</a> {words(1, 3)}</p></div>'
        return f"<div>{words(1, 4)} <a href=/>{words(2, 6)}</a></div>"

    def boiler() -> str:
        kind = draw.randrange(12)
        if kind < 3:
            tag = draw.choice(["nav", "div class=menu", 'ul class="nav-links"', "aside"])
            return f"<{tag}><ul>{linked(draw.randint(2, 8))}</ul></{tag.split()[0]}>"
        if kind < 6:
            name = draw.choice(["ad", "advert", "sidebar", "cookie-notice", "newsletter", "related", "share"])
            return f'<div class="{name}"><p>{words(1, 40)}</p></div>'
        if kind < 8:
            return f"<form><label>{words(1, 3)}</label><p>{words(1, 12)}</p></form>"
        if kind < 10:
            name = draw.choice(['<section id="comments">', '<div class="comments">'])
            return name + "".join(f"<div><p>{words(3, 40)}</p></div>" for _ in range(draw.randint(1, 4))) + f"</{name[1:].split()[0]}>"
        return f"<aside><h3>{words(1, 4)}</h3><p>{words(2, 30)}</p></aside>"

    for _ in range(pages):
        body: set[str] = set()
        named = draw.random() < 0.6
        container = draw.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id="main">', "</div>"), ("<div>", "</div>")]) if named else ("<div>", "</div>")
        hints = container[0] != "<div>"
        other = boiler if named else plain
        title = words(3, 10)
        heading = f"<h1>{title}</h1>"
        inside = [f"<header>{heading}</header>" if hints and draw.random() < 0.2 else heading]
        body.add(title)
        for _ in range(draw.randint(1, 9)):
            own = words(1, 60) if hints else words(12, 80)
            body.add(own)
            first, _, rest = own.partition(" ")
            inside.append(draw.choice([f"<p>{own}</p>", f"<p>{own}</p>", f"<p><a href='/x'>{first}</a> {rest}</p>", f"<p><b>{own}<br>", f"<blockquote>{own}</blockquote>"]))
            if draw.random() < 0.15:
                inside.append(draw.choice([other, plain])())
        before = [f"<header><a href=/>{words(1, 3)}</a><p>{words(1, 8)}</p></header>", *(other() for _ in range(draw.randint(0, 3)))]
        after = [*(other() for _ in range(draw.randint(0, 3))), f"<footer><p>{words(2, 20)}</p></footer>"]
        if draw.random() < 0.5:  # plain text outside of the article
            before.append(f"<div>{words(1, 6)}</div>")
        yield "<html><body>" + "".join(before) + container[0] + "".join(inside) + container[1] + "".join(after) + "</body></html>", body


#: What names say: features that are hidden in one of two copies of each row of the sample.
NAMED = [FEATURES.index(x) for x in ("boiler", "main", "page_has_main", "header")]
#: Bounds of the labelled sample: pages, and blocks of them.
SAMPLE_PAGES, SAMPLE_BLOCKS = 400, 20_000


def labelled_blocks(pages: int = 400, seed: int = 7) -> list[tuple[list[float], float]]:
    """The small labelled table: features and whether a block is the article's."""
    rows = []
    for page, body in labelled_pages(pages, seed):
        texts, features = blocks(page)
        rows += [(row.tolist(), float(text in body)) for text, row in zip(texts, features)]
    return rows


def said_by_names(features: np.ndarray) -> np.ndarray:
    """Whether the names of a page say that its blocks are the article's: in a page with a main part
    those in it, else all, but for those that names say to be something else."""
    boiler, main, has_main, header = (features[:, k] > 0 for k in NAMED)
    return np.where(has_main, main & ~boiler, ~boiler & ~header)


def labelled_sample(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """features and label of blocks of at most SAMPLE_PAGES of the pages, chosen by hashes, and SAMPLE_BLOCKS of
    their blocks, labelled by their names. Each row comes twice: as it is, and with what names say hidden, so that
    words and link densities have to tell."""

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for page in frame["html"]:
                _, features = blocks(page or "")
                labels = said_by_names(features).astype(float)
                hidden = features.copy()
                hidden[:, NAMED] = 0
                both = [*features.tolist(), *hidden.tolist()]
                if both:
                    yield pd.DataFrame({"x": both, "label": [*labels, *labels]})

    html_ = F.col(f"`{html_column}`")
    rows = pages.where(html_.isNotNull()).select(html_.alias("html"), F.xxhash64(html_).alias("_hash"))
    # by their hashes some four times as many are looked at as are taken, however many there are; copies once
    share = min(1.0, 4 * SAMPLE_PAGES / max(1, pages.count()))
    few = rows.where(F.pmod("_hash", F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("_hash").agg(F.min("html").alias("html")).orderBy("_hash").limit(SAMPLE_PAGES).select("html")
    small_batches(pages.sparkSession)
    return few.mapInPandas(compute, "x array<double>, label double").orderBy(F.xxhash64("x"), "x", "label").limit(SAMPLE_BLOCKS)


def train(spark, pages: DataFrame | None = None, html_column: str = "html", seed: int = 7, depth: int = 12) -> dict[str, np.ndarray]:
    """The decision tree, trained by Spark on the made pages and, where pages are given, their labelled sample."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    table = spark.createDataFrame(labelled_blocks(seed=seed), "x array<double>, label double")
    if pages is not None:
        table = table.union(labelled_sample(pages, html_column))
    rows = table.select(array_to_vector("x").alias("features"), "label").coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=3, maxBins=128, seed=seed).fit(rows)
    return tree_arrays(model._java_obj.rootNode())


def chosen(tree: dict[str, np.ndarray], features: np.ndarray) -> np.ndarray:
    """The blocks of the article. Where the tree finds none, in a page in which names say nothing of any
    block: those that aren't links for the most part."""
    found = predict(tree, features) > 0.5
    if not found.any() and not features[:, NAMED].any():
        return features[:, 1] < 0.5
    return found


def main_text(page: str | None, tree: dict[str, np.ndarray]) -> str:
    """The blocks of the article, a line each."""
    texts, features = blocks(page or "")
    if not texts:
        return ""
    return "\n".join(x for x, y in zip(texts, chosen(tree, features)) if y)


def extracted(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """pages' other columns with text and n_chars (code points)."""
    tree = train(pages.sparkSession, pages, html_column)
    kept = [f for f in pages.schema.fields if f.name != html_column and f.name not in ("text", "n_chars")]

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(x, tree) for x in frame[html_column]]
            yield frame[[f.name for f in kept]].assign(text=texts, n_chars=[len(x) for x in texts])

    small_batches(pages.sparkSession)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string, n_chars long"])
    return pages.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{html_column}`")).mapInPandas(compute, schema)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extracted(pages.select("page_id", "url", "html"))
