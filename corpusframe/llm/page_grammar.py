"""Labelled pages to fit a block labeller on: a random grammar of page layouts, filled with given words.

The names below are the usual ones of page regions; a layout draws some of them, in usual orders, and every
text of it is either article (1) or not (0). Words carry no label: both kinds draw from the same words, the
short phrases of page furniture apart.
"""

from __future__ import annotations

import random

# Usual names of regions in classes and ids, and usual phrases in them.
NAMES = {
    "header": "header masthead banner top-bar site-header page-header branding logo topbar",
    "nav": "nav menu navigation navbar main-menu top-nav breadcrumb breadcrumbs pagination pager toc tabs skip-links sitemap",
    "notice": "cookie-notice cookie-banner consent gdpr alert notice popup modal overlay paywall notification disclaimer warning announcement privacy-notice",
    "ad": "ad ads advert advertisement sponsored promo ad-slot banner-ad adsbygoogle sponsor promotion dfp outbrain taboola",
    "sidebar": "sidebar side widget rail right-column secondary left-col widget-area side-panel",
    "footer": "footer colophon copyright bottom site-info site-footer legal footer-links credits",
    "comments": "comments comment-list responses replies discussion disqus commentlist user-comments reader-comments respond",
    "related": "related more-stories recommended read-next trending popular related-posts latest most-read see-also teaser",
    "share": "share social share-buttons sharing follow social-links toolbar print tools",
    "form": "search newsletter login signup contact subscribe search-form comment-form register poll",
    "content": "content post entry entry-content article-body story post-content main-content text body page article main story-body post-body wrapper container hentry single",
}
PHRASES = ("home|about us|contact|login|sign in|register|search|menu|next|previous|share|reply|print|read more|subscribe|accept all cookies|we use cookies on this site|privacy policy|terms of use|"
           "all rights reserved|copyright|follow us|advertisement|sponsored|related stories|most read|leave a comment|posted by|your email|submit|accueil|connexion|mentions légales|"
           "partager|commentaires|publicité|startseite|anmelden|impressum|datenschutz|anzeige|kommentare|inicio|contacto|aviso legal|publicidad|compartir|comentarios").split("|")
TAGS = {"header": ["header", "div"], "nav": ["nav", "div", "ul"], "notice": ["div", "section", "aside", "p"], "ad": ["div", "aside", "ins", "section"], "sidebar": ["aside", "div"],
        "footer": ["footer", "div"], "comments": ["section", "div", "ol"], "related": ["section", "div", "aside", "ul"], "share": ["div", "ul"], "form": ["form"]}


class Page:
    def __init__(self, rng: random.Random, words: list[str]):
        self.rng, self.words, self.parts, self.labels = rng, words, [], []

    def text(self, label: int, low: int, high: int) -> str:
        """A text of some words; its label is noted, as it will be a leaf of its own."""
        self.labels.append(label)
        n = self.rng.randint(low, high)
        out = " ".join(self.rng.choice(self.words) for _ in range(n))
        if not label and self.rng.random() < 0.5:
            out = self.rng.choice(PHRASES) + (" " + out if self.rng.random() < 0.3 else "")
        elif n > 5 and self.rng.random() < 0.9:
            out = out[:1].upper() + out[1:] + "."
        return out or "x"

    def link(self, label: int, low: int, high: int) -> str:
        return f'<a href="/x">{self.text(label, low, high)}</a>'

    def open(self, region: str) -> str:
        """Opens an element of a region; the element's end."""
        rng = self.rng
        tag = rng.choice(TAGS[region])
        plain = tag in ("nav", "header", "footer", "aside", "form") and (tag != "aside" or region == "sidebar")
        name = rng.choice(NAMES[region].split())
        kind = rng.choice(["class", "class", "id"])
        given = "" if plain and rng.random() < 0.5 else f' {kind}="{name}{rng.choice(["", "", f" box{rng.randint(1, 9)}"])}"'
        self.parts.append(f"<{tag}{given}>")
        return f"</{tag}>"

    def furniture(self, region: str) -> None:
        rng = self.rng
        end = self.open(region)
        if region in ("nav", "share", "related", "footer", "header") and rng.random() < 0.8:
            wrap = "ul" not in end
            items = "".join(f"<li>{self.link(0, 1, 6 if region == 'related' else 2)}</li>" for _ in range(rng.randint(2, 8)))
            self.parts.append(f"<ul>{items}</ul>" if wrap else items)
        elif region == "form":
            self.parts.append(f"<label>{self.text(0, 1, 3)}</label><input name=q><button>{self.text(0, 1, 2)}</button>")
        elif region == "comments":
            self.parts.append(f"<h3>{self.text(0, 1, 3)}</h3>")
            for _ in range(rng.randint(1, 6)):
                box = rng.choice(["li", "div"])
                self.parts.append(f'<{box} class="{rng.choice(["comment", "reply", "user", "message"])}"><p>{self.text(0, 1, 60)}</p></{box}>')
        if region in ("footer", "notice", "ad", "sidebar", "header") or rng.random() < 0.1:
            for _ in range(rng.randint(1, 3)):
                box = rng.choice(["p", "div", "h3", "span"])
                self.parts.append(f"<{box}>{self.text(0, 2, 40)}</{box}><hr>")
        self.parts.append(end)

    def article(self) -> None:
        rng = self.rng
        style = rng.random()
        ends = []
        for _ in range(rng.choice([0, 0, 1, 2])):
            self.parts.append(f'<div class="{rng.choice(NAMES["content"].split())}">')
            ends.append("</div>")
        if style < 0.45:
            self.parts.append(rng.choice(["<article>", '<article class="post">', "<main><article>", "<main>"]))
            ends.append("</article></main>" if "<main><article>" == self.parts[-1] else "</main>" if self.parts[-1] == "<main>" else "</article>")
        elif style < 0.9:
            tag = rng.choice(["div", "div", "section", "td"])
            self.parts.append(f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(NAMES["content"].split())}">')
            ends.append(f"</{tag}>")
        head = rng.random()
        if head < 0.8:
            level = rng.choice([1, 1, 2])
            h = f"<h{level}>{self.text(1, 1, 12)}</h{level}>"
            self.parts.append(f"<header>{h}</header>" if head < 0.15 else h)
        body = rng.choice(["p", "p", "p", "p", "div", "mixed", "mixed"])
        for _ in range(rng.choice([1, 2, 4, 8, 14, 24])):
            kind = "p" if body == "p" else "div" if body == "div" and rng.random() < 0.9 else rng.choice(["p", "p", "p", "h2", "h3", "ul", "blockquote", "pre", "figure", "table", "dl"])
            long = rng.choice([3, 20, 60])
            if kind == "p":
                bold = rng.random() < 0.2
                self.parts.append(f"<p>{'<b>' if bold else ''}{self.text(1, 1, long)}{'<br>' if bold else '</p>' if rng.random() < 0.8 else ''}")
            elif kind == "ul":
                self.parts.append("<ul>" + "".join(f"<li>{self.link(1, 1, 4) if rng.random() < 0.2 else self.text(1, 1, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind == "blockquote":
                self.parts.append(f"<blockquote><p>{self.text(1, 3, 30)}</p></blockquote>")
            elif kind == "figure":
                self.parts.append(f'<figure><img src="x.png"><figcaption>{self.text(1, 2, 12)}</figcaption></figure>')
            elif kind == "table":
                self.parts.append("<table>" + "".join(f"<tr><td>{self.text(1, 1, 4)}</td><td>{self.text(1, 1, 4)}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>")
            elif kind == "dl":
                self.parts.append(f"<dl><dt>{self.text(1, 1, 3)}</dt><dd>{self.text(1, 3, 20)}</dd></dl>")
            else:
                self.parts.append(f"<{kind}>{self.text(1, 1, 8 if kind[0] == 'h' else long)}</{kind}>")
            if rng.random() < 0.04:
                self.furniture(rng.choice(["ad", "share", "related", "form", "notice", "sidebar"]))
        for region in ("share", "related", "footer", "form", "comments"):
            if rng.random() < 0.08:
                self.furniture(region)
        self.parts += reversed(ends)

    def build(self) -> tuple[str, list[int]]:
        rng = self.rng
        self.parts.append("<!DOCTYPE html><html><head><title>x y</title><style>p{}</style></head><body>")
        for region, share in (("notice", 0.2), ("header", 0.5), ("nav", 0.7), ("ad", 0.4), ("form", 0.2), ("nav", 0.15), ("sidebar", 0.2)):
            if rng.random() < share:
                self.furniture(region)
        if rng.random() < 0.97:
            self.article()
        for region, share in (("ad", 0.2), ("share", 0.2), ("related", 0.3), ("comments", 0.4), ("sidebar", 0.3), ("form", 0.2), ("nav", 0.1), ("footer", 0.8), ("notice", 0.15)):
            if rng.random() < share:
                self.furniture(region)
        return "".join(self.parts) + ("</body></html>" if rng.random() < 0.8 else ""), self.labels


def pages(n: int, words: list[str], seed: int = 7) -> list[tuple[str, list[int]]]:
    """``n`` pages and the labels of their leaves."""
    rng = random.Random(seed)
    return [Page(rng, words).build() for _ in range(n)]
