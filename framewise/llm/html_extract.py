"""Main text of web pages by a conditional random field over DOM leaf blocks.

A block's features are its ancestor tags, the words of their class and id, and the shape of its
text (length, links, punctuation, place in the page). The chain is trained on labelled pages:
pages composed here from labelled parts in many layouts (so that articles without an article tag,
and notices, forms or comments inside one, are known), and at most ``SAMPLE`` pages of the table
that mark their article with a tag. Blocks that Viterbi labels as text are joined by one blank.

Cases: a NULL or empty html gives ''; a page cut anywhere, in a tag or an entity too, is read as
far as it goes; a page of any length is one row, and its cost is linear in it; equal pages get
equal texts; an empty table gives no rows (the model is then trained on composed pages alone);
further columns are not carried.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.crf import Chain, train
from framewise.llm.html_blocks import MAIN_TAGS, Around, Block, blocks
from framewise.llm.labelled import smallest

SAMPLE = 300  # labelled pages of the table
COMPOSED = 400
CHAIN = 512  # blocks; a longer labelled page is several chains in training
GOLD = "zzgold"

# fixed values: names that web pages commonly give to their parts
BOILER_TAGS = frozenset(
    "nav header footer aside form button select option menu dialog textarea fieldset legend label figcaption".split()
)
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "contact cookie cookies copyright disclaimer disqus feedback follow footer form gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion "
    "recommended related replies reply respond search share sharing side sidebar signup social sponsor sponsored "
    "subscribe subscription tags toolbar topbar widget widgets alert complementary contentinfo".split()
)
MAIN_NAMES = frozenset("article body content entry main post prose story text".split())


def known_names(chain: Chain) -> frozenset[str]:
    """The class and id words that the model looks at."""
    return BOILER_NAMES | MAIN_NAMES | {f[5:] for f in chain.weights if f.startswith("name:")}


@lru_cache(maxsize=20_000)
def path_features(at: Around) -> tuple[str, ...]:
    """What the tags around a block say; only what is inside the innermost article counts as inner."""
    out = [f"own:{at.own}", f"parent:{at.parent}"]
    out += [f"in:{t}" for t in sorted(at.tags)]
    out += [f"name:{n}" for n in sorted(at.names) if n != GOLD]
    boiler = bool(at.names & BOILER_NAMES) or bool(at.tags & BOILER_TAGS)
    if boiler:
        out.append("boiler")
    if at.inner is not None:
        inside = bool(at.inner_names & BOILER_NAMES) or bool(at.inner & BOILER_TAGS)
        out.append("article:boiler" if inside else "article:clean")
    elif at.names & MAIN_NAMES:
        out.append("main:boiler" if boiler else "main:clean")
    return tuple(out)


def text_features(block: Block, place: int, count: int) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    share = block.linked / len(text)
    out = [
        "bias", f"words:{min(words.bit_length(), 8)}", f"linked:{0 if share < 0.1 else 1 if share < 0.6 else 2}",
        "stop" if text[-1] in ".!?…\"'”" else "open", f"place:{4 * place // count}",
    ]
    if text[0] in "©»›|":
        out.append("mark")
    if ". " in text or ", " in text:
        out.append("prose")
    return out


def features(page: list[Block]) -> list[list[str]]:
    n = len(page)
    return [[*path_features(b.around), *text_features(b, i, n)] for i, b in enumerate(page)]


def extract(html: str | None, chain: Chain, looked_at: frozenset[str] | None = None) -> str:
    """The main text of one page; ``looked_at`` spares finding the `known_names` for each."""
    page = blocks(html or "", known_names(chain) if looked_at is None else looked_at)
    weight = chain.weights.get
    n = len(page)
    known: dict[Around, float] = {}
    scores = []
    for i, b in enumerate(page):
        if b.around not in known:
            known[b.around] = sum(weight(f, 0.0) for f in path_features(b.around))
        scores.append(known[b.around] + sum(weight(f, 0.0) for f in text_features(b, i, n)))
    return " ".join(b.text for b, label in zip(page, chain.decode(scores), strict=True) if label)


def tagged_labels(page: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article by a tag; None for other pages."""
    if all(b.around.inner is None for b in page):
        return None
    return [int("article:clean" in path_features(b.around)) for b in page]


def gold_labels(page: list[Block]) -> list[int]:
    """Labels of a composed page."""
    return [int(GOLD in b.around.names) for b in page]


class Composer:
    """Labelled pages: content in some wrapper, boilerplate around it and sometimes in it."""

    # fixed values: wrappers of content, and of the other parts
    WRAPPERS = (
        "article", "article class=post", "main", "div class=content", "div id=main-content", "div class=article-body",
        "section class=story", "div class=entry-content", "div class=post-text", "div",
    )
    PARTS = (
        ("nav", "links"), ("header", "words"), ("header class=site-header", "links"), ("div class=menu", "links"),
        ("ul class=navigation", "links"), ("div class=breadcrumbs", "links"), ("aside", "prose"), ("aside class=sidebar", "links"),
        ("div class=sidebar", "prose"), ("div id=sidebar", "links"), ("div class=ad", "prose"), ("div class=advert", "words"),
        ("div class=sponsored", "prose"), ("div class=cookie-notice", "prose"), ("div class=notice", "prose"),
        ("div role=alert", "words"), ("section class=comments", "comments"), ("div id=comments", "comments"),
        ("div class=comment-list", "comments"), ("form class=search", "form"), ("form", "form"), ("div class=newsletter", "form"),
        ("footer", "prose"), ("footer class=site-footer", "links"), ("div class=footer", "words"), ("div class=related", "links"),
        ("div class=share", "words"), ("div class=promo", "prose"), ("div class=popup", "prose"),
    )

    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        letters = "etaoinshrdlu"
        count = self.random.randint(low, high)
        return " ".join("".join(self.random.choices(letters, k=self.random.randint(1, 9))) for _ in range(count))

    def prose(self, sentences: int) -> str:
        ends = [".", ".", "!", "?", ", and."]
        return " ".join(self.words(1, 18).capitalize() + self.random.choice(ends) for _ in range(sentences))

    def part(self, kind: str) -> str:
        r = self.random
        if kind == "links":
            rows = "".join(f'<li><a href="/x">{self.words(1, 3)}</a></li>' for _ in range(r.randint(2, 8)))
            return r.choice([f"<ul>{rows}</ul>", f"<h3>{self.words(1, 3)}</h3><ul>{rows}</ul>"])
        if kind == "words":
            return r.choice(["<p>{}</p>", "<span>{}</span>", "{}"]).format(self.words(1, 6))
        if kind == "comments":
            each = ""
            for _ in range(r.randint(1, 4)):
                name, said = r.choice(["comment", "reply", "x"]), self.prose(r.randint(1, 4))
                each += f"<div class={name}><b>{self.words(1, 2)}</b><p>{said}</p></div>"
            return f"<h3>{self.words(1, 2)}</h3>{each}"
        if kind == "form":
            field = f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>"
            return f"{field}<p>{self.words(2, 9)}</p>"
        text, short = self.prose(r.randint(1, 4)), self.words(1, 4)
        return r.choice([text, f"<p>{text}</p>", f"<h4>{short}</h4><p>{text}</p>", f"&copy; {short} &middot; {text}"])

    def boiler(self) -> str:
        tag, kind = self.random.choice(self.PARTS)
        return f"<{tag}>{self.part(kind)}</{tag.split()[0]}>"

    def content(self) -> list[str]:
        r = self.random
        out = [f"<h1 class={GOLD}>{self.words(1, 9)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 8)):
            kind = r.choice(["p"] * 12 + ["h2", "blockquote", "ul", "pre"])
            if kind == "ul":
                rows = "".join(f"<li class={GOLD}>{self.words(1, 12)}</li>" for _ in range(r.randint(2, 4)))
                out.append(f"<ul>{rows}</ul>")
            else:
                text = self.words(1, 6) if kind == "h2" else self.prose(r.randint(1, 6))
                if r.random() < 0.2:
                    text += f' <a href="/y">{self.words(1, 3)}</a>.'
                out.append(f"<{kind} class={GOLD}>{text}</{kind}>")
        return out

    def page(self) -> str:
        r = self.random
        inner = self.content()
        while r.random() < 0.45:
            inner.insert(r.randint(0, len(inner)), self.boiler())
        tag = r.choice(self.WRAPPERS)
        before = "".join(self.boiler() for _ in range(r.randint(0, 4)))
        after = "".join(self.boiler() for _ in range(r.randint(0, 4)))
        body = f"{before}<{tag}>{''.join(inner)}</{tag.split()[0]}>{after}"
        if r.random() < 0.3:
            body = f"<div id={r.choice(['page', 'wrap', 'container'])}>{body}</div>"
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{body}</body></html>"


def labelled_pages(htmls: list[str]) -> tuple[list[list[list[str]]], list[list[int]]]:
    """Features and labels: the composed pages, then those of ``htmls`` that mark their article.

    All blocks of a page are used. One of more than ``CHAIN`` blocks is cut into several chains, which
    costs the moves at the cuts only; features are those of the whole page.
    """
    pages, labels = [], []

    def add(page: list[Block], marked: list[int]) -> None:
        rows = features(page)
        for i in range(0, len(rows), CHAIN):
            pages.append(rows[i : i + CHAIN])
            labels.append(marked[i : i + CHAIN])

    composer = Composer(7)
    for _ in range(COMPOSED):
        page = blocks(composer.page())
        add(page, gold_labels(page))
    for html in htmls:
        page = blocks(html)
        marked = tagged_labels(page)
        if marked is not None:
            add(page, marked)
    return pages, labels


def fitted(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = SAMPLE) -> Chain:
    """A chain trained on composed pages and ``sample`` whole pages with the smallest hash of their key."""
    some = pages.filter(F.col(html).isNotNull()).select(
        F.xxhash64(key).alias("_h"), F.col(html).alias("_html")
    )
    rows = smallest(some, F.col("_h"), sample, pages.count()).select("_html").collect()
    return train(*labelled_pages([r["_html"] for r in rows]))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, url, ``text`` and ``n_chars`` (its code points)."""
    sent = pages.sparkSession.sparkContext.broadcast(fitted(pages, key, html))

    def texts(batch: pd.Series) -> pd.Series:
        names = known_names(sent.value)
        return pd.Series(np.array([extract(h, sent.value, names) for h in batch], dtype=object), dtype=object)

    out = pages.select(key, url, F.pandas_udf(texts, "string")(F.col(html)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
