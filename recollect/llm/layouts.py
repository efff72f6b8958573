"""Labelled pages for the extraction model: texts of real pages laid out again by a grammar of page parts."""

from __future__ import annotations

import html

import numpy as np

from recollect.llm.dom import MARKS

#: Class names of page parts whose prose only a name tells from an article's (fixed values).
NAMED = {
    "advert": "ad ads advert ad-box ad-slot advertisement sponsored sponsor-content promo promo-box promotion banner adsbygoogle ad-container",
    "notice": "cookie-notice cookie-banner consent gdpr notice site-notice alert popup modal newsletter subscribe newsletter-signup cookieConsent announcement",
    "side": "sidebar side widget right-rail related related-posts recommended widget-area sidebar-right popular trending aside-box",
    "comment": "comments comment-list comment comments-area discussion replies responses commentlist disqus_thread reader-comments feedback reviews",
    "foot": "footer site-footer colophon copyright page-footer legal foot bottom",
    "head": "header site-header masthead topbar page-header branding logo",
    "menu": "menu nav navbar navigation main-menu breadcrumbs breadcrumb top-nav pagination pager skip-links",
}
#: Names of what holds an article, and of what holds anything (fixed values).
HOLDERS = "article content post post-content entry-content story article-body main-content body-text prose hentry single-post articleBody page-content copy".split()
WRAPPERS = "container wrapper page row col inner outer layout grid box wrap site app root section clearfix u1 x9 content-wrap main-wrap page-body".split()
WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city".split()


class Writer:
    """Draws pages. Truth is written as an attribute that features do not read."""

    def __init__(self, rng: np.random.Generator, sentences: list[str], phrases: list[str]):
        self.rng, self.sentences, self.phrases = rng, sentences, phrases

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def one(self, of):
        return of[int(self.rng.integers(len(of)))]

    def words(self, most: int) -> str:
        return " ".join(self.one(WORDS) for _ in range(int(self.rng.integers(1, most + 1)))).capitalize()

    def phrase(self) -> str:
        return html.escape(self.one(self.phrases)) if self.phrases and self.chance(0.7) else self.words(4)

    def prose(self, most: int) -> str:
        """One to ``most`` sentences, now and then of one word."""
        if self.chance(0.06):
            return self.words(2) + "."
        said = [html.escape(self.one(self.sentences)) if self.sentences and self.chance(0.8) else self.words(18) + "." for _ in range(int(self.rng.integers(1, most + 1)))]
        if self.chance(0.25):
            k = int(self.rng.integers(len(said)))
            said[k] = self.one(['<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "<span>{}</span>", "<b>{}<br>", "<i>{}</i><br>"]).format(said[k])
        return " ".join(said)

    def name(self, kind: str, sure: bool = False) -> str:
        """A class or id of a kind of part; without ``sure`` it may have none or one that says nothing."""
        if not sure and self.chance(0.3):
            return self.one(["", f' class="{self.one(WRAPPERS)}"'])
        of = NAMED[kind].split() if kind in NAMED else HOLDERS
        word = self.one(of)
        if self.chance(0.2):
            word = self.one([*MARKS[kind].split()])
        return self.one([' class="{}"', ' id="{}"', ' class="{} x1"', ' class="u {}"', ' class="{}-1" id="b2"']).format(word)

    def part(self, tag: str, kind: str, inside: str, truth: int = 0, sure: bool = False) -> str:
        return f'<{tag}{self.name(kind, sure)} data-truth="{truth}">{inside}</{tag}>'

    def links(self, few: int, many: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.phrase()}</a></li>' for k in range(int(self.rng.integers(few, many))))

    def menu(self) -> str:
        style = self.rng.integers(3)
        if style == 0:
            return self.part("nav", "menu", self.one(["<ul>{}</ul>", "<ol>{}</ol>"]).format(self.links(2, 10)))
        if style == 1:
            return self.part("div", "menu", f"<ul>{self.links(3, 12)}</ul>")
        return self.part(self.one(["div", "nav", "p"]), "menu", self.one([" | ", " &raquo; ", " "]).join(f'<a href="/{k}">{self.phrase()}</a>' for k in range(int(self.rng.integers(2, 8)))), sure=True)

    def header(self) -> str:
        inside = self.one(["<h1>{}</h1>", "<h2>{}</h2>", '<div class="logo">{}</div>', "<a href='/'>{}</a>", "<p>{}</p>"]).format(self.phrase())
        inside += f"<p>{self.prose(1)}</p>" * self.chance(0.4) + self.menu() * self.chance(0.5)
        return self.part("header", "head", inside) if self.chance(0.6) else self.part("div", "head", inside, sure=True)

    def footer(self) -> str:
        inside = self.one(["&copy; {}", "<p>&copy; 2024 {}. All rights reserved.</p>", "<span>{}</span>"]).format(self.phrase())
        inside += self.one(["", f"<p>{self.prose(3)}</p>", f" &middot; {self.prose(2)}", f"<ul>{self.links(2, 7)}</ul>"])
        return self.part("footer", "foot", inside) if self.chance(0.7) else self.part("div", "foot", inside, sure=True)

    def advert(self) -> str:
        inside = self.one(["{}", "<p>{}</p>", "<a href='/buy'>{}</a>", "<div><span>{}</span></div>", "<h4>Sale</h4><p>{}</p>"]).format(self.prose(4))
        return f"<!-- {self.words(2)} -->" * self.chance(0.3) + self.part(self.one(["div", "div", "aside", "section", "ins", "p"]) if not inside.startswith(("<p", "<h", "<d")) else self.one(["div", "aside", "section"]), "advert", inside, sure=True)

    def notice(self) -> str:
        inside = self.one(["{}", "<p>{}</p>", "<h3>Notice</h3><p>{}</p>", "<div><p>{}</p></div>"]).format(self.prose(4)) + self.one(["", "<button>OK</button>", "<a href='#'>Accept</a>"])
        return self.part(self.one(["div", "section", "aside", "dialog"]), "notice", inside, sure=True)

    def sidebar(self) -> str:
        boxes = []
        for _ in range(int(self.rng.integers(1, 4))):
            head = self.one(["<h3>{}</h3>", "<h4>{}</h4>", "<h2>{}</h2>", "<p><b>{}</b></p>"]).format(self.phrase())
            boxes.append(head + self.one([f"<ul>{self.links(2, 8)}</ul>", f"<p>{self.prose(3)}</p>", f"<div>{self.prose(2)}</div>", f"<p>{self.prose(3)}</p><p>{self.prose(3)}</p>"]))
        inside = "".join(self.one(["<div>{}</div>", "<section>{}</section>", "{}"]).format(b) for b in boxes)
        return self.part("aside", "side", inside) if self.chance(0.5) else self.part(self.one(["div", "section"]), "side", inside, sure=True)

    def comments(self) -> str:
        said = [self.one(["<div class='comment'><span>{}</span><p>{}</p></div>", "<li><b>{}</b><p>{}</p></li>", "<article class='comment'><h4>{}</h4><p>{}</p></article>", "<div><p>{}</p><p>{}</p></div>"]).format(self.phrase(), self.prose(6)) for _ in range(int(self.rng.integers(1, 8)))]
        inside = self.one(["<h3>{} comments</h3>", "<h2>Comments</h2>{}", "{}"]).format(len(said)) + self.one(["{}", "<ol>{}</ol>", "<div>{}</div>"]).format("".join(said)) + self.form() * self.chance(0.4)
        return self.part(self.one(["section", "div", "div", "aside"]), "comment", inside, sure=True)

    def form(self) -> str:
        inside = self.one(["<label>{}</label>", "<p>{}</p>", "<h3>{}</h3>"]).format(self.one([self.phrase(), self.prose(2)])) + '<input type="text">' + self.one(["", "<textarea></textarea>", "<select><option>A</select>"]) + self.one(["<button>Go</button>", '<input type="submit">'])
        return self.one(['<form data-truth="0">{}</form>', '<form class="search-form" data-truth="0">{}</form>', '<div class="login" data-truth="0"><form>{}</form></div>']).format(inside)

    def share(self) -> str:
        return f'<div class="{self.one(["share", "social", "share-buttons", "sharing"])}" data-truth="0">' + " ".join(f'<a href="#">{self.words(1)}</a>' for _ in range(4)) + "</div>"

    def hidden(self) -> str:
        return self.one(['<div hidden data-truth="0"><p>{}</p></div>', '<div style="display: none" data-truth="0">{}</div>', '<div aria-hidden="true" class="x" data-truth="0"><p>{}</p></div>']).format(self.prose(4))

    def article(self) -> str:
        """What counts: headings, paragraphs, lists, quotes and tables, with other parts strewn in."""
        out = []
        if self.chance(0.8):
            head = f"<h1>{self.phrase()}</h1>"
            out.append(self.one([head, head, head, f"<header>{head}</header>", f'<header class="entry-header">{head}<p>{self.prose(1)}</p></header>']))
        for _ in range(int(self.rng.choice([1, 2, 3, 5, 8, 13, 20]))):
            kind = self.rng.random()
            if kind < 0.72:
                out.append(self.one(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p class='t'>{}</p>"]).format(self.prose(8)))
            elif kind < 0.82:
                out.append(self.one(["<h2>{}</h2>", "<h3>{}</h3>", "<h4>{}</h4>"]).format(self.phrase()))
            elif kind < 0.88:
                out.append(self.one(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{self.prose(2)}</li>" for _ in range(int(self.rng.integers(2, 6))))))
            elif kind < 0.92:
                out.append(f"<blockquote>{self.one(['<p>{}</p>', '{}']).format(self.prose(3))}</blockquote>")
            elif kind < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{self.phrase()}</td><td>{self.words(2)}</td></tr>" for _ in range(int(self.rng.integers(2, 5)))) + "</table>")
            elif kind < 0.97:
                out.append(f"<figure><img src='a.png'><figcaption>{self.prose(1)}</figcaption></figure>")
            else:
                out.append(f"<pre>{self.prose(3)}</pre>")
        for make, p in ((self.advert, 0.25), (self.notice, 0.08), (self.sidebar, 0.1), (self.share, 0.15), (self.form, 0.05), (self.comments, 0.08), (self.menu, 0.08)):
            if self.chance(p):
                out.insert(int(self.rng.integers(len(out) + 1)), make())
        if self.chance(0.12):
            out.append(f"<footer data-truth='0'>{self.phrase()}</footer>")
        inside = "".join(out)
        tag = self.one(["article", "article", "article", "main", "div", "div", "section", "td"])
        name = self.name("content") if self.chance(0.6) else ""
        whole = f'<{tag}{name} data-truth="1">{inside}</{tag}>'
        if tag == "td":
            return f"<table><tr>{whole}</tr></table>"
        return f"<main>{whole}</main>" if tag != "main" and self.chance(0.25) else whole

    def page(self) -> str:
        top = [make() for make, p in ((self.header, 0.6), (self.menu, 0.7), (self.notice, 0.3), (self.advert, 0.4), (self.form, 0.15), (self.hidden, 0.1)) if self.chance(p)]
        low = [make() for make, p in ((self.share, 0.15), (self.advert, 0.25), (self.comments, 0.4), (self.sidebar, 0.4), (self.form, 0.1), (self.menu, 0.2), (self.notice, 0.2)) if self.chance(p)]
        if self.chance(0.3) and low:
            top.append(low.pop())
        self.rng.shuffle(top)
        middle = "".join(top) + (self.article() if self.chance(0.95) else "") + "".join(low)
        for _ in range(int(self.rng.choice([0, 0, 1, 1, 2, 4]))):
            middle = f'<div{self.one(["", " class=\'" + self.one(WRAPPERS) + "\'", " id=\'" + self.one(WRAPPERS) + "\'"])}>{middle}</div>'
        loose = f'<a href="#m" data-truth="0">Skip</a>' * self.chance(0.05)
        body = loose + middle + (self.footer() if self.chance(0.75) else "") + (self.notice() if self.chance(0.1) else "")
        return f"<!DOCTYPE html><html><head><title>{self.phrase()}</title><style>p{{}}</style></head><body>{body}" + self.one(["</body></html>", ""])


def pages(seed: int, many: int, sentences: list[str], phrases: list[str]) -> list[str]:
    writer = Writer(np.random.default_rng(seed), sentences, phrases)
    return [writer.page() for _ in range(many)]
