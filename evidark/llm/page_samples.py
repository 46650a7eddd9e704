"""Made-up web pages with known main text, from which the block labeller learns."""

from __future__ import annotations

import numpy as np

# Names that page authors give to regions.
ADVERT = "ad ads advert advertisement sponsored sponsor promo promotion adsense adbox banner commercial".split()
NOTICE = "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe signup paywall announcement warning toast message".split()
SIDE = "sidebar side aside widget rail secondary related recommended trending popular more tags archive archives calendar blogroll teaser recent".split()
NAVIGATION = "nav navbar navigation menu topnav breadcrumb breadcrumbs pager pagination toc tabs skip links".split()
HEADER = "header masthead top branding logo site tagline search login topbar".split()
FOOTER = "footer foot bottom copyright legal credits colophon disclaimer".split()
SHARE = "share sharing social follow tools meta actions".split()
COMMENTS = "comment comments commentlist reply replies disqus respond discussion reactions feedback responses".split()
FORM = "form contact search login signup poll survey".split()
CONTENT = "content article post entry story body text main page prose copy markdown primary wrapper container column inner news blog".split()
# Words of menus, notices and the like.
WORDS = "home about contact login search menu share follow copyright rights reserved privacy terms cookies accept subscribe newsletter comments reply posted author tags related read more next previous advertisement sponsored inicio contacto buscar accueil rechercher startseite impressum datenschutz kontakt suche © · | » email name send submit".split()
SYLLABLES = "th an er on in re ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ch un sch ge ein ción que os la el eau ment tion é ü ß ñ".split()


class Maker:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def some(self, low: int, high: int) -> range:
        return range(int(self.rng.integers(low, high + 1)))

    def one(self, items: list):
        return items[int(self.rng.integers(len(items)))]

    def word(self) -> str:
        return "".join(self.one(SYLLABLES) for _ in self.some(1, 4))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in self.some(low, high))

    def sentences(self, low: int, high: int) -> str:
        style = self.rng.random()
        said = [self.words(1, 16).capitalize() + "." for _ in self.some(low, high)]
        text = " ".join(said)
        if style < 0.06:
            text = " ".join(w + self.one(["###", "***", "%%%", "$$$", "&amp;&amp;"]) for w in text.split())
        elif style < 0.1:
            text = text.upper().replace(".", "!!")
        elif style < 0.14:
            text = " | ".join(text.split())
        return text

    def short(self) -> str:
        return self.one(WORDS) if self.chance(0.6) else self.words(1, 3)

    def attributes(self, names: list[str]) -> str:
        if self.chance(0.12):
            return ""
        name = self.one(names)
        if self.chance(0.3):
            name += self.one(["-", "_", " "]) + self.one(["box", "area", "block", "wrap", "left", "right", "1", "list", "inner", self.word()])
        return f' {self.one(["class", "class", "id"])}="{name}"'

    def marks(self, text: str, keep: int) -> list[tuple[str, int]]:
        return [(text, keep)]

    # Each part is a list of (markup, None) and (text, 1 if it is main text else 0).
    def leaf(self, tag: str, text: str, keep: int, attributes: str = "") -> list:
        if self.chance(0.15):
            inner = self.one(["b", "i", "em", "span", "strong", "a"])
            open_, close = f"<{tag}{attributes}><{inner}>", f"</{inner}></{tag}>"
        else:
            open_, close = f"<{tag}{attributes}>", f"</{tag}>"
        if tag == "p" and self.chance(0.2):
            close = self.one(["", "<br>"])
        return [(open_, None), (text, keep), (close, None)]

    def within(self, tag: str, parts: list, attributes: str = "") -> list:
        return [(f"<{tag}{attributes}>", None), *parts, (f"</{tag}>", None)]

    def links(self, low: int = 2, high: int = 9) -> list:
        items = [x for _ in self.some(low, high) for x in self.within("li", [("<a href='/x'>", None), (self.short(), 0), ("</a>", None)])]
        return self.within(self.one(["ul", "ol"]), items)

    def prose(self, keep: int, low: int = 1, high: int = 3) -> list:
        return [x for _ in self.some(low, high) for x in self.leaf(self.one(["p", "p", "div", "span"]), self.sentences(1, 3), keep)]

    def advert(self) -> list:
        inner = [(self.sentences(1, 2) if self.chance(0.7) else self.short(), 0)] if self.chance(0.6) else self.prose(0, 1, 2)
        return self.within(self.one(["div", "div", "aside", "section", "ins"]), inner, ' class="' + self.one(ADVERT) + self.one(["", "-slot", " box", "-top", "_1"]) + '"')

    def notice(self) -> list:
        inner = self.prose(0, 1, 2) if self.chance(0.6) else [(self.sentences(1, 2), 0)]
        if self.chance(0.4):
            inner += self.leaf("button", self.short(), 0)
        return self.within(self.one(["div", "section", "dialog", "aside"]), inner, f' {self.one(["class", "id", "role"])}="{self.one(NOTICE)}{self.one(["", "-bar", "-banner", " wide"])}"')

    def menu(self) -> list:
        return self.within("nav", self.links(), self.attributes(NAVIGATION) if self.chance(0.4) else "") if self.chance(0.6) else self.within("div", self.links(), self.named(NAVIGATION))

    def named(self, names: list[str]) -> str:
        return self.attributes(names) or f' class="{names[0]}"'

    def header(self) -> list:
        inner = self.leaf(self.one(["h1", "div", "p", "span"]), self.words(1, 4), 0) + (self.prose(0, 1, 1) if self.chance(0.4) else [])
        inner += self.menu() if self.chance(0.4) else []
        return self.within("header", inner, self.attributes(HEADER) if self.chance(0.4) else "") if self.chance(0.6) else self.within("div", inner, self.named(HEADER))

    def footer(self) -> list:
        text = f"&copy; {self.word()}.example.com &middot; {self.sentences(1, 1)}" if self.chance(0.6) else self.sentences(1, 2)
        inner = [(text, 0)] if self.chance(0.6) else self.leaf("p", text, 0)
        inner += self.links() if self.chance(0.4) else []
        return self.within("footer", inner, self.attributes(FOOTER) if self.chance(0.3) else "") if self.chance(0.65) else self.within("div", inner, self.named(FOOTER))

    def side(self) -> list:
        inner = self.leaf(self.one(["h2", "h3", "h4", "div"]), self.words(1, 3), 0) + (self.links() if self.chance(0.6) else self.prose(0))
        return self.within("aside", inner, self.attributes(SIDE) if self.chance(0.5) else "") if self.chance(0.5) else self.within(self.one(["div", "section", "ul"]), inner, self.named(SIDE))

    def share(self) -> list:
        return self.within("div", self.links(2, 5) if self.chance(0.5) else [(self.short(), 0)], self.named(SHARE))

    def form(self) -> list:
        inner = [x for _ in self.some(1, 3) for x in self.leaf(self.one(["label", "p", "legend", "div"]), self.words(1, 6), 0) + [("<input name=q>", None)]]
        inner += self.leaf("button", self.short(), 0) if self.chance(0.7) else self.within("select", [x for _ in self.some(1, 4) for x in self.leaf("option", self.short(), 0)])
        return self.within("form", inner, self.attributes(FORM) if self.chance(0.3) else "")

    def comments(self) -> list:
        out = self.leaf(self.one(["h2", "h3", "h4"]), self.words(1, 3), 0) if self.chance(0.7) else []
        for _ in self.some(1, 5):
            said = (self.leaf(self.one(["span", "div", "cite", "b"]), self.words(1, 3), 0) if self.chance(0.5) else []) + self.prose(0, 1, 2)
            out += self.within(self.one(["div", "li", "article"]), said, ' class="' + self.one(COMMENTS) + '"' if self.chance(0.8) else "")
        return self.within(self.one(["div", "section", "ol"]), out, f' {self.one(["id", "class"])}="{self.one(COMMENTS)}{self.one(["", "-area", " list", "-section"])}"')

    def clutter(self) -> list:
        return self.one([self.advert, self.notice, self.share, self.form, self.side, self.advert])()

    def article(self) -> list:
        out = []
        brief = self.chance(0.15)  # short blocks from the start, one text again and again at times
        again = self.words(1, 4).capitalize() + "." if self.chance(0.3) else ""
        if self.chance(0.6 if brief else 0.85):
            title = self.leaf("h1", self.words(1, 12), 1) if self.chance(0.8) else self.leaf("h2", self.words(1, 12), 1)
            out += self.within("header", title) if self.chance(0.1) else title
        for _ in self.some(1, 60 if brief and self.chance(0.2) else 14):
            kind = self.rng.random()
            if brief and kind < 0.85:
                out += self.leaf("p" if self.chance(0.8) else self.one(["div", "li"]), again or self.words(1, 6).capitalize() + self.one([".", ".", "", "!"]), 1)
            elif kind < 0.75:
                out += self.leaf("p" if self.chance(0.9) else "div", self.sentences(1, 6), 1)
            elif kind < 0.8:
                out += self.leaf(self.one(["h2", "h3", "h4"]), self.words(1, 8), 1)
            elif kind < 0.84:
                out += self.within(self.one(["ul", "ol"]), [x for _ in self.some(1, 5) for x in self.leaf("li", self.words(2, 14), 1)])
            elif kind < 0.87:
                out += self.within("blockquote", self.leaf("p", self.sentences(1, 2), 1)) if self.chance(0.6) else self.leaf("blockquote", self.sentences(1, 2), 1)
            elif kind < 0.9:
                out += self.within("table", [x for _ in self.some(1, 3) for x in self.within("tr", [y for _ in self.some(2, 3) for y in self.leaf(self.one(["td", "th"]), self.words(1, 4), 1)])])
            elif kind < 0.93:
                out += self.leaf("pre", self.words(3, 20), 1) if self.chance(0.5) else self.within("figure", self.leaf("figcaption", self.words(2, 9), 1))
            else:
                out += self.clutter()
        out += self.share() if self.chance(0.15) else []
        out += self.comments() if self.chance(0.12) else []
        shell = self.rng.random()
        if shell < 0.45:
            out = self.within("article", out, self.attributes(CONTENT) if self.chance(0.3) else "")
        elif shell < 0.6:
            out = self.within("main", out, self.attributes(CONTENT) if self.chance(0.3) else "")
        elif shell < 0.95:
            out = self.within(self.one(["div", "div", "section", "td"]), out, f' {self.one(["class", "id"])}="{self.one(CONTENT)}{self.one(["", "-body", "-content", "-text", " wide"])}"')
        if self.chance(0.3):
            out = self.within("div", out, self.attributes(CONTENT) if self.chance(0.6) else ' class="x"')
        return out

    def page(self) -> list:
        """(markup, None), (text, keep) in page order."""
        out = [("<!DOCTYPE html><html><head><meta charset='utf-8'>", None)] if self.chance(0.85) else []
        if self.chance(0.8):
            out += [("<title>", None), (self.words(1, 9), 0), ("</title>", None)]
        if self.chance(0.8):
            out += [("<style>p{margin:0}</style><script>var t='</p>';</script></head><body>", None)]
        bare = self.chance(0.12)  # the article with little or nothing around it
        share = 0.1 if bare else 1.0
        before = [f for f, p in ((self.notice, 0.2), (self.header, 0.5), (self.menu, 0.7), (self.advert, 0.45), (self.side, 0.2), (self.form, 0.1)) if self.chance(p * share)]
        after = [f for f, p in ((self.share, 0.2), (self.comments, 0.35), (self.side, 0.4), (self.advert, 0.25), (self.form, 0.15), (self.footer, 0.85), (self.notice, 0.12)) if self.chance(p * (0.4 if bare else 1.0))]
        if self.chance(0.3):
            self.rng.shuffle(before)
        body = [x for f in before for x in f()]
        if self.chance(0.97):
            body += self.article()
        body += [x for f in after for x in f()]
        if self.chance(0.2):
            body = self.within("div", body, self.attributes(CONTENT))
        return out + body + ([("</body></html>", None)] if self.chance(0.9) else [])
