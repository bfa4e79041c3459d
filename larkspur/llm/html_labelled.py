"""Labelled pages for fitting the extraction CRF: varied layouts, each block known to be main text or not.

The pages are made here, from a seed: article frames of several kinds around invented prose, with menus,
headers, footers, sidebars, notices, adverts, forms and reader comments in semantic tags, in classes and
ids only, or bare. Furniture of every kind may hold prose that looks like main text, stand before or after it, or be
hidden; layout tables have menus and notes in cells of their own. Every block's text is unique on its page, so a label
goes by text.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

SYLLABLES = "an be con de el er fa ga hi in ka la me no or pa qui ra su ta un ver wo xi yo ze ß é ñ ü".split()
CLASSES = {
    "nav": ["nav", "menu", "main-menu", "navbar", "breadcrumbs", "site-nav", "pagination", "topbar"],
    "head": ["header", "site-header", "masthead", "logo", "hero-banner"],
    "foot": ["footer", "site-footer", "copyright", "legal", "bottom-links"],
    "side": ["sidebar", "side", "widget", "related", "related-posts", "recommended", "trending", "share-buttons", "social", "popular-posts", "author-bio"],
    "ad": ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad", "advertisement"],
    "notice": ["cookie", "cookie-banner", "consent", "notice", "alert", "newsletter", "popup", "modal", "subscribe-box", "notification"],
    "comment": ["comments", "comment-list", "comment", "replies", "discussion", "user-comments", "responses"],
    "form": ["search-form", "login", "contact-form", "signup", "subscribe-form"],
    "main": ["content", "article-body", "post", "post-content", "entry-content", "story", "main-content", "body-text", "text"],
}
SEMANTIC = {"nav": ["nav"], "head": ["header"], "foot": ["footer"], "side": ["aside"], "form": ["form"], "ad": ["aside"], "comment": ["section"], "notice": ["dialog", "section"]}
PHRASES = {
    "nav": ["Home", "About us", "Contact", "Menu", "News", "Next page", "Previous"],
    "foot": ["© 2024 {}", "All rights reserved. {}", "Terms of use {}", "Privacy policy {}", "Copyright {}", "Impressum {}"],
    "notice": ["We use cookies {}.", "Accept all {}", "Subscribe to our newsletter {}", "Sign up for {} today!", "This site uses cookies, {}."],
    "ad": ["Advertisement {}", "Buy now: {}!", "Sponsored {}", "Save 20% off {}", "{}."],
    "comment": ["Posted by {}", "Reply {}", "Leave a comment {}", "{}: I agree, {}."],
    "side": ["Related: {}", "Read more about {}", "Share {}", "Follow us on {}", "More from {}"],
    "form": ["Search {}", "Your email {}", "Log in {}", "Send {}"],
    "head": ["{} daily", "The {} times", "{}"],
}


class _Maker:
    def __init__(self, rng: random.Random):
        self.rng, self.used = rng, set()

    def words(self, n: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))

    def unique(self, make) -> str:
        while True:
            s = " ".join(make().split())
            if s not in self.used:
                self.used.add(s)
                return s

    def sentence(self, lo: int, hi: int) -> str:
        w = self.words(self.rng.randint(lo, hi)).split()
        for i in range(4, len(w) - 1, 9):
            w[i] += self.rng.choice([",", ",", "", ";"])
        return " ".join(w).capitalize() + self.rng.choice([".", ".", ".", "!", "?"])

    def paragraph(self, odd: bool = False) -> str:
        n, r = self.rng.choice([1, 1, 2, 3, 4, 6]), self.rng
        if odd and r.random() < 0.25:  # main text may look like anything: lists in a line, digits, the furniture's own words
            cue = r.choice([*PHRASES["nav"], "cookie", "related", "share", "comment", "copyright ©", "subscribe", "log in", "sponsored", "2024", "e-mail"])
            return self.unique(lambda: r.choice([" | ", " · ", " ", "% ", ": "]).join([*self.words(r.randint(1, 16)).split(), cue][:: r.choice([1, -1])]) + r.choice(["", "", ".", " |"]))
        return self.unique(lambda: " ".join(self.sentence(1 if n == 1 else 3, 18) for _ in range(n)))

    def phrase(self, kind: str) -> str:
        def make() -> str:
            p = self.rng.choice(PHRASES.get(kind, ["{}"]) + ["{}"])
            return p.replace("{}", self.words(self.rng.randint(1, 5)))

        return self.unique(make)


def _decorate(rng: random.Random, tag: str, kind: str, inner: str, must: bool = False) -> str:
    name = rng.choice(CLASSES[kind])
    attr = rng.choice([f' class="{name}"', f' id="{name}"', f' class="box {name}"', f" class='{name} wide'"]) if must or rng.random() < 0.6 else ""
    return f"<{tag}{attr}>{inner}</{tag}>"


def _prose(m: _Maker) -> str:
    """One to three paragraphs or a bare stretch of ordinary sentences, perhaps below a heading."""
    r = m.rng
    paras = [m.unique(lambda: " ".join(m.sentence(4, 20) for _ in range(r.choice([1, 1, 2, 3])))) for _ in range(r.choice([1, 1, 1, 2, 3]))]
    inner = paras[0] if len(paras) == 1 and r.random() < 0.4 else "".join(f"<p>{p}</p>" for p in paras)
    return (f"<h{(h := r.randint(1, 4))}>{m.unique(lambda: m.words(r.randint(1, 6)).capitalize())}</h{h}>" if r.random() < 0.25 else "") + inner


#: What a hidden element's tag may say.
UNSEEN = [" hidden", ' hidden=""', ' style="display:none"', " style='color: red; display: none'", ' aria-hidden="true"', " class=note hidden"]


def _unseen(m: _Maker) -> str:
    """Text that a browser doesn't show."""
    tag = m.rng.choice(["div", "div", "section", "p", "aside"])
    return f"<{tag}{m.rng.choice(UNSEEN)}>{m.unique(lambda: m.sentence(3, 18)) if tag == 'p' else _prose(m)}</{tag}>"


def _cell(m: _Maker) -> str:
    """A layout table's cell beside the main text: links one below the other, or a short note with a link."""
    r = m.rng
    link = lambda s: f'<a href="/{s.split()[0]}">{s}</a>'
    items = [link(m.phrase("nav")) for _ in range(r.randint(2, 7))]
    return r.choice(["<br>".join(items), " ".join(items), "".join(f"<div>{x}</div>" for x in items), "".join(f"<p>{x}</p>" for x in items), "<ul><li>" + "<li>".join(items) + "</ul>"])


def _other(m: _Maker, kind: str) -> str:
    """A stretch of page furniture."""
    r = m.rng
    semantic = kind in SEMANTIC and r.random() < 0.55
    tag = r.choice(SEMANTIC[kind]) if semantic else r.choice(["div", "div", "section", "ul"] if kind in ("nav", "side") else ["div", "div", "section",
        "p"] if kind in ("ad", "notice") else ["div", "div", "section"])
    link = lambda s: f'<a href="/{s.split()[0]}">{s}</a>'
    if tag != "p" and r.random() < 0.35:  # prose that looks like main text, told by its place alone
        return _decorate(r, "div" if tag == "ul" else tag, kind, _prose(m), must=not semantic or tag == "section")
    if kind == "nav":
        items = [link(m.phrase("nav")) for _ in range(r.randint(2, 8))]
        inner = "".join(f"<li>{x}</li>" for x in items) if tag == "ul" else r.choice([f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>",
            " | ".join(items), "".join(f"<div>{x}</div>" for x in items)])
    elif kind == "comment":
        inner = "".join(f"<div class='{r.choice(['c', 'item', 'comment'])}'><b>{m.phrase('comment')}</b><p>{m.paragraph()}</p></div>" for _ in range(r.randint(1, 5)))
        inner = r.choice([f"<h{r.randint(2, 4)}>{m.phrase('comment')}</h{0}>".replace("</h0>", "</h3>"), ""]) + inner
    elif kind == "form":
        inner = f"<label>{m.phrase('form')}</label><input name=q><button>{m.phrase('form')}</button>" + (f"<p>{m.paragraph()}</p>" if r.random() < 0.3 else "")
    elif kind == "side":
        inner = r.choice([f"<h3>{m.phrase('side')}</h3>", ""]) + (f"<ul>{''.join(f'<li>{link(m.phrase(chr(120)))}</li>' for _ in range(r.randint(1, 6)))}</ul>" if r.random() < 0.7 else f"<p>{m.paragraph()}</p>")
        inner = inner.replace("<h3>", "<li>").replace("</h3>", "</li>") if tag == "ul" else inner
    elif kind == "head":
        inner = r.choice([f"<h1>{m.phrase('head')}</h1>" if semantic else f"<div>{m.phrase('head')}</div>", f"<a href='/'>{m.phrase('head')}</a>", f"<p>{m.phrase('head')}</p>"])
    elif kind == "foot":
        inner = r.choice(["<p>{}</p>", "{}", "<small>{}</small>"]).format(m.phrase("foot") + r.choice([" · ", " | ", " "]) + m.unique(lambda: m.sentence(2, 9)))
    else:
        text = r.choice([m.phrase(kind), m.unique(lambda: m.sentence(2, 14)), m.paragraph()])
        inner = text if tag == "p" else r.choice([f"<p>{text}</p>", text, f"<a href='x'>{text}</a>"])
    return _decorate(r, tag, kind, inner, must=not semantic or tag == "section")


def _article(m: _Maker, main: set[str], noise: bool) -> str:
    r = m.rng
    out = []

    def keep(s: str) -> str:
        main.add(s)
        return s

    if r.random() < 0.8:
        title = keep(m.unique(lambda: m.words(r.randint(2, 12)).capitalize() + r.choice(["", "", "."])))
        out.append(r.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<h2>{title}</h2>", f"<header><h1>{title}</h1></header>"]))
    for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
        k = r.random()
        if k < 0.72:
            p = keep(m.paragraph(odd=True))
            if r.random() < 0.2:
                w = p.split()
                w[len(w) // 2] = f'<a href="/x">{w[len(w) // 2]}</a>'
                p = " ".join(w)
            out.append(r.choice([f"<p>{p}</p>"] * 5 + [f"<p>{p}", f"<div>{p}</div>", f"<p><b>{p}<br></b>"]))
        elif k < 0.80:
            out.append(f"<h{(h := r.randint(2, 4))}>{keep(m.unique(lambda: m.words(r.randint(1, 7)).capitalize()))}</h{h}>")
        elif k < 0.87:
            t = r.choice(["ul", "ol"])
            out.append(f"<{t}>" + "".join(f"<li>{keep(m.unique(lambda: m.sentence(1, 10)))}</li>" for _ in range(r.randint(2, 5))) + f"</{t}>")
        elif k < 0.92:
            out.append(f"<blockquote>{r.choice(['<p>{}</p>', '{}']).format(keep(m.paragraph()))}</blockquote>")
        elif k < 0.96:
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{keep(m.unique(lambda: m.words(r.randint(1, 4))))}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
        else:
            out.append(r.choice([f"<pre>{keep(m.unique(lambda: m.words(6)))}</pre>", f"<figure><img src=x><figcaption>{keep(m.unique(lambda: m.sentence(3, 9)))}</figcaption></figure>"]))
        if noise and r.random() < 0.12:
            out.append(_unseen(m) if r.random() < 0.35 else _other(m, r.choice(["ad", "notice", "side", "form", "nav", "foot"])))
    if r.random() < 0.25:  # parts of the article in plain or named sections and boxes
        k = r.randint(0, len(out) - 1)
        out[k:] = [r.choice(["<section>{}</section>", "<section>{}</section>", '<section class="chapter">{}</section>', "<div>{}</div>",
            '<div class="section">{}</div>']).replace("{}", "".join(out[k:]))]
    if noise and r.random() < 0.2:
        out.append(_other(m, r.choice(["comment", "side", "nav"])))
    return "".join(out)


#: Marks whose inside is no text of the page, with signs that look like marks or quotes.
HIDDEN = [
    "<script>if (a <b && c> 'd') { x = \"</p><p>{}\"; } // it's</script>", "<!-- <p>{}</p> it's \"quoted -->", "<style>p > a::before {{ content: '<{}'; }}</style>",
    "<script type='text/x'><div class=\"x>{}</div></script>", "<noscript><p>{}</p></noscript>", "<svg><title>{}</title><text>{}</text></svg>",
        "<template><p>{}</p></template>", "<textarea>{} <p></textarea>",
]


def _alone(m: _Maker, main: set[str]) -> str:
    """A page of the main text only: a block or a few, in few elements or in none."""
    r = m.rng

    def keep(s: str) -> str:
        main.add(s)
        return s

    kind = r.choice(["p", "p", "text", "lines", "article", "div", "titled", "several", "main"])
    if kind == "titled":
        return f"<h{(h := r.randint(1, 3))}>{keep(m.unique(lambda: m.words(r.randint(1, 9)).capitalize()))}</h{h}><p>{keep(m.paragraph())}</p>"
    if kind == "several":
        return "".join(f"<p>{keep(m.paragraph(odd=True))}</p>" for _ in range(r.randint(2, 6)))
    if kind == "lines":
        parts = [m.paragraph() for _ in range(r.randint(2, 4))]
        main.add(" ".join(parts))
        return "<br>".join(parts)
    text = keep(m.paragraph(odd=True))
    return {"p": f"<p>{text}</p>", "text": text, "article": f"<article><p>{text}</p></article>", "div": f"<div>{text}</div>", "main": f"<main>{text}</main>"}[kind]


def labelled_pages(n: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    """n pages, each with the texts of its main blocks. One in eight has no furniture at all; marks that hold
    no text stand between the parts."""
    for k in range(n):
        rng = random.Random(f"{seed}/{k}")
        m, main = _Maker(rng), set()
        if rng.random() < 0.125:
            body = _alone(m, main)
            yield rng.choice(["{}", "<html><body>{}</body></html>", "<!doctype html><html><head><title>t</title></head><body>{}</body></html>",
                "<body>{}", "<html><head><title>t</title>{}"]).replace("{}", body), main
            continue
        body = _article(m, main, noise=rng.random() < 0.6)
        frame = rng.choice(["article", "article", "article", "main", "main-article", "div", "div", "bare", "td", "layout"])
        if frame == "main-article":
            body = f"<main>{_decorate(rng, 'article', 'main', body)}</main>"
        elif frame in ("article", "main"):
            body = _decorate(rng, frame, "main", body)
        elif frame == "div":
            body = f"<div id=page>{_decorate(rng, 'div', 'main', body, must=True)}</div>"
        elif frame == "td":
            body = f"<table><tr><td>{body}</td></tr></table>"
        elif frame == "layout":
            cells = [f"<td>{body}</td>", f"<td{rng.choice(['', ' width=20%', ' valign=top'])}>{_cell(m)}</td>"]
            cells = cells if rng.random() < 0.3 else cells[::-1]
            body = f"<table><tr>{''.join(cells)}</tr></table>"
        before = [_other(m, c) for c in rng.sample(["nav", "head", "ad", "notice", "form", "side", "foot"], rng.randint(0 if frame == "layout" else 1, 4))]
        after = [_other(m, c) for c in rng.sample(["foot", "side", "comment", "notice", "ad", "nav", "form", "head"], rng.randint(0 if frame == "layout" else 1, 4))]
        for side in (before, after):
            if rng.random() < 0.08:
                side.insert(rng.randint(0, len(side)), _unseen(m))
        parts = [*before, body, *after]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(HIDDEN).replace("{}", m.words(3)))
        page = f"<html><head><title>{m.words(4)}</title><style>p{{}}</style></head><body>" + "".join(parts)
        yield page + rng.choice(["</body></html>", "</body></html>", ""]), main
