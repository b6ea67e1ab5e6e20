"""Labelled pages for the extractor: whole pages made by rule, each block marked main text or not.

The corpus carries no labels, so the training pages are built here: many layouts
(semantic tags, class names only, bare containers), each with menus, headers,
sidebars, notices, adverts, forms, comments and footers around an article.
Words are invented, so a model learns shape and place, not vocabulary.
"""

from __future__ import annotations

import random

SYLLABLES = "an er th on re in ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()


def word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def phrase(r: random.Random, low: int, high: int) -> str:
    return " ".join(word(r) for _ in range(r.randint(low, high)))


def sentences(r: random.Random, low: int, high: int) -> str:
    out = []
    for _ in range(r.randint(low, high)):
        s = phrase(r, 1, 18)
        if r.random() < 0.4:
            s = s.replace(" ", ", ", 1)
        out.append(s.capitalize() + r.choice(".....?!"))
    return " ".join(out)


class Page:
    """Collects html in which \x01 opens a main-text block and \x02 any other."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.html: list[str] = []

    def add(self, s: str) -> None:
        self.html.append(s)

    def main(self, s: str) -> str:
        return "\x01" + s

    def other(self, s: str) -> str:
        return "\x02" + s

    def attrs(self, names: list[str]) -> str:
        r = self.r
        if r.random() < 0.25:
            return ""
        name = r.choice(names)
        if r.random() < 0.5:
            name = r.choice(["", "site-", "page-", "main-", "post-", "c-"]) + name + r.choice(["", "-inner", "-wrap", " clearfix", "__box"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def links(self, n: int, list_: bool) -> str:
        r = self.r
        items = [self.other(phrase(r, 1, 3).title()) for _ in range(n)]
        if list_:
            return "<ul>" + "".join(f'<li><a href="/{i}">{t}</a></li>' for i, t in enumerate(items)) + "</ul>"
        return " | ".join(f'<a href="/{i}">{t}</a>' for i, t in enumerate(items))

    def menu(self) -> str:
        r = self.r
        tag = r.choice(["nav", "nav", "div"])
        return f'<{tag}{self.attrs(["nav", "menu", "navbar", "breadcrumb", "links"])}>{self.links(r.randint(3, 9), r.random() < 0.8)}</{tag}>'

    def header(self) -> str:
        r = self.r
        tag = r.choice(["header", "div"])
        body = r.choice([f"<a href='/'>{self.other(phrase(r, 1, 3).title())}</a>", f"<p>{self.other(phrase(r, 2, 6).title())}</p>", f"<h1>{self.other(phrase(r, 1, 3).title())}</h1><p>{self.other(phrase(r, 3, 7))}</p>" if tag == "header" else f"<span>{self.other(phrase(r, 1, 4))}</span>"])
        return f'<{tag}{self.attrs(["header", "masthead", "banner", "top", "logo"])}>{body}{self.menu() if r.random() < 0.4 else ""}</{tag}>'

    def advert(self) -> str:
        r = self.r
        inner = r.choice([self.other(sentences(r, 1, 2)), f"<p>{self.other(sentences(r, 1, 1))}</p>", f'<a href="/x">{self.other(phrase(r, 2, 6))}</a>'])
        return f'<div class="{r.choice(["ad", "ads", "advert", "sponsor", "promo", "ad-slot", "banner-ad", "sponsored", "advertisement"])}">{inner}</div>'

    def notice(self) -> str:
        r = self.r
        tag = r.choice(["div", "div", "section", "aside"])
        name = r.choice(["cookie", "cookie-notice", "notice", "consent", "alert", "gdpr", "newsletter", "popup", "modal", "subscribe", "cookie-banner", "notification"])
        return f'<{tag} {r.choice(["class", "id"])}="{name}"><p>{self.other(sentences(r, 1, 2))}</p>{f"<button>{self.other(word(r).title())}</button>" if r.random() < 0.7 else ""}</{tag}>'

    def sidebar(self) -> str:
        r = self.r
        tag = r.choice(["aside", "aside", "div"])
        name = f' class="{r.choice(["sidebar", "side", "widget", "related", "aside", "recommend", "trending", "widget-area"])}"' if tag == "div" or r.random() < 0.6 else ""
        body = f'<h{r.randint(2, 4)}>{self.other(phrase(r, 1, 3).title())}</h{3}>' if r.random() < 0.7 else ""
        body += r.choice([self.links(r.randint(2, 6), True), f"<p>{self.other(sentences(r, 1, 3))}</p>", f"<p>{self.other(sentences(r, 1, 2))}</p>" + self.links(3, True)])
        return f"<{tag}{name}>{body}</{tag}>"

    def form(self) -> str:
        r = self.r
        return f'<form{self.attrs(["search", "form", "login", "signup", "contact"])}><label>{self.other(phrase(r, 1, 3).title())}</label><input type="text">{f"<select><option>{self.other(word(r))}</option><option>{self.other(word(r))}</option></select>" if r.random() < 0.4 else ""}<button>{self.other(word(r).title())}</button></form>'

    def comments(self) -> str:
        r = self.r
        tag, kind = r.choice([("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "discussion"), ("div", "responses"), ("div", "reader-comments")])
        body = f"<h3>{self.other(str(r.randint(1, 90)) + ' ' + word(r))}</h3>" if r.random() < 0.7 else ""
        for _ in range(r.randint(1, 5)):
            inner = f"<p>{self.other(sentences(r, 1, 4))}</p>"
            if r.random() < 0.6:
                inner = f"<span>{self.other(word(r).title())}</span>" + inner
            body += r.choice([f'<div class="comment">{inner}</div>', f'<li class="comment">{inner}</li>', f"<div>{inner}</div>", f'<article class="comment">{inner}</article>'])
        return f'<{tag} {r.choice(["class", "id"])}="{kind}">{body}</{tag}>'

    def footer(self) -> str:
        r = self.r
        tag = r.choice(["footer", "footer", "div"])
        name = self.attrs(["footer", "bottom", "copyright", "legal"]) if tag == "footer" else f' class="{r.choice(["footer", "foot", "copyright", "bottom-bar", "site-footer"])}"'
        body = r.choice([self.other("&copy; " + phrase(r, 1, 4) + " &middot; " + sentences(r, 1, 3)), f"<p>{self.other('&copy; ' + phrase(r, 2, 6))}</p>", self.links(r.randint(2, 5), True) + f"<p>{self.other(sentences(r, 1, 2))}</p>"])
        return f"<{tag}{name}>{body}</{tag}>"

    def article(self) -> str:
        r = self.r
        out = []
        if r.random() < 0.9:
            h = r.choice(["h1", "h1", "h2"])
            title = r.choice([phrase(r, 2, 9).capitalize(), sentences(r, 1, 1), "&amp; " + phrase(r, 2, 6)])
            out.append(f"<{h}>{self.main(title)}</{h}>")
        broken = r.random() < 0.35
        for _ in range(r.randint(1, 14)):
            kind, text = r.random(), sentences(r, 1, 9) if r.random() < 0.85 else phrase(r, 1, 4).capitalize() + "."
            if r.random() < 0.2:
                w = text.split()
                k = r.randrange(len(w))
                w[k] = r.choice([f'<a href="/y">{w[k]}</a>', f"<b>{w[k]}</b>", f"<em>{w[k]}</em>"])
                text = " ".join(w)
            if broken and kind < 0.2:
                out.append(f"<p><b>{self.main(text)}<br>")
            elif kind < 0.8:
                out.append(f"<p>{self.main(text)}</p>")
            elif kind < 0.86:
                out.append(f"<h{r.choice([2, 3])}>{self.main(phrase(r, 1, 6).capitalize())}</h2>")
            elif kind < 0.91:
                out.append("<ul>" + "".join(f"<li>{self.main(phrase(r, 2, 14).capitalize())}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.95:
                out.append(f"<blockquote><p>{self.main(text)}</p></blockquote>")
            else:
                out.append(f"<table><tr><td>{self.main(phrase(r, 1, 5))}</td><td>{self.main(phrase(r, 1, 5))}</td></tr></table>")
            if r.random() < 0.05:
                out.append(self.advert())
            if r.random() < 0.02:
                out.append(self.sidebar())
        body = "".join(out)
        kind = r.random()
        if kind < 0.55:
            return f"<article{self.attrs(['post', 'entry', 'article', 'story']) if r.random() < 0.3 else ''}>{body}</article>"
        if kind < 0.7:
            return f"<main>{body}</main>"
        return f'<div{self.attrs(["content", "article-body", "entry-content", "post-content", "story", "main", "text", "post", "article"])}>{body}</div>'

    def build(self) -> str:
        r = self.r
        top = [p() for p, odds in ((self.header, 0.5), (self.menu, 0.75), (self.notice, 0.2), (self.advert, 0.4), (self.form, 0.2), (self.sidebar, 0.15)) if r.random() < odds]
        end = [p() for p, odds in ((self.advert, 0.2), (self.sidebar, 0.35), (self.comments, 0.35), (self.form, 0.2), (self.notice, 0.15), (self.menu, 0.1)) if r.random() < odds]
        r.shuffle(end)
        if r.random() < 0.85:
            end.append(self.footer())
        if r.random() < 0.08:
            end.append(self.notice())
        middle = self.article()
        wrap = r.random()
        if wrap < 0.2:
            middle = f'<div class="{r.choice(["container", "wrapper", "page", "layout", "row"])}">{middle}{"".join(end[:1])}</div>'
            end = end[1:]
        elif wrap < 0.3:
            middle = f"<main>{middle}</main>"
        body = "".join(top) + middle + "".join(end)
        cut = r.random()
        return f"<!DOCTYPE html><html><head><title>{phrase(r, 2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{body}" + ("</body></html>" if cut < 0.9 else "")


def pages(n: int, seed: int = 1) -> list[str]:
    """Whole pages; \\x01 and \\x02 stand before the text of each block."""
    return [Page(seed * 1_000_003 + i).build() for i in range(n)]
