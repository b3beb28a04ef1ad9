"""Labelled pages for the extraction model, made from layout rules.

Each page arranges an article and other regions at random: menus, headers,
footers, sidebars, notices, adverts, forms and comments, each under element and
class names that are common on the web. ``data-y`` tells what a region is.
"""

from __future__ import annotations

import random

#: The attribute with the label: c for content, o for everything else.
MARK = "data-y"

# Words seen in class and id names, by region.
NAMES = {
    "menu": "nav navbar navigation menu mainmenu breadcrumb breadcrumbs pagination pager tabs links toolbar sitenav skip",
    "header": "header masthead topbar branding logo site head banner hero title tagline",
    "footer": "footer foot colophon copyright legal bottom imprint siteinfo credits",
    "sidebar": "sidebar aside side rail widget widgets related recommended popular trending tags archive blogroll secondary more share social",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay banner message paywall warning privacy disclaimer",
    "advert": "ad ads adv advert advertisement adbox sponsor sponsored promo promotion teaser banner commercial",
    "form": "form search searchform login signup subscribe newsletter contact register subscription",
    "comments": "comments comment reply replies discussion thread respond responses feedback reviews",
    "content": "content article post entry story main body text maincontent page blog single hentry articlebody primary section chapter",
    "wrapper": "wrapper container wrap layout row col grid outer inner site page",
}
TAGS = {
    "menu": "nav nav nav div ul", "header": "header header div", "footer": "footer footer div", "sidebar": "aside div div section",
    "notice": "div div section dialog", "advert": "div div div aside ins section", "form": "form form div section",
    "comments": "section div div ol", "content": "article article main div div section",
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        letters = "abcdefghijklmnoprstuvw"
        return " ".join("".join(self.r.choices(letters, k=self.r.randint(2, 9))) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.r.choice("....?!") for _ in range(self.r.randint(low, high)))

    def names(self, region: str) -> str:
        if self.r.random() < 0.25:
            return ""
        pool = NAMES[region].split()
        some = self.r.choice("-_ ").join(self.r.sample(pool, self.r.choice([1, 1, 2])))
        return f' {self.r.choice(["class", "class", "id"])}="{some}"'

    def element(self, region: str, body: str, label: str) -> str:
        tag = self.r.choice(TAGS[region].split())
        named = self.names(region)
        if not named and tag in ("div", "section", "ul", "ol"):
            pool = NAMES[region].split()
            named = f' class="{self.r.choice(pool)}"'
        return f'<{tag}{named} {MARK}="{label}">{body}</{tag}>'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/x">{self.words(1, 5)}</a>' for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return " | ".join(items)

    def region(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            body = self.links(2, 9)
        elif kind == "header":
            body = r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 3)}</div>"]) + r.choice(["", f"<p>{self.sentences(1, 1)}</p>", self.links(3, 6)])
        elif kind == "footer":
            body = r.choice(["&copy; ", "", f"<p>{self.sentences(1, 2)}</p>"]) + self.words(1, 4) + r.choice([" &middot; ", "<br>"]) + self.sentences(1, 3) + r.choice(["", self.links(2, 5)])
        elif kind == "sidebar":
            body = f"<h3>{self.words(1, 4)}</h3>" + r.choice([self.links(3, 8), f"<p>{self.sentences(1, 2)}</p>", f"<p>{self.sentences(1, 9)}</p>" * r.randint(1, 3)])
        elif kind == "notice":
            body = f"<p>{self.sentences(1, 6)}</p>" + r.choice(["", "<button>Ok</button>", '<a href="/x">' + self.words(1, 2) + "</a>"])
        elif kind == "advert":
            body = r.choice([self.sentences(1, 3), f'<a href="/x">{self.words(2, 8)}</a>', f"<p>{self.sentences(1, 7)}</p>"])
        elif kind == "form":
            body = r.choice([f"<p>{self.sentences(1, 1)}</p>", f"<label>{self.words(1, 3)}</label>"]) + "<input name=q><button>Go</button>"
        else:
            item = "<div class=comment><b>{}</b><p>{}</p></div>" if r.random() < 0.6 else "<li><p>{} {}</p></li>"
            body = f"<h3>{self.words(1, 3)}</h3>" + "".join(item.format(self.words(1, 2), self.sentences(1, r.choice([3, 5, 9]))) for _ in range(r.randint(1, 5)))
        return self.element(kind, body, "o")

    def article(self) -> str:
        r = self.r
        title = f"<h1>{self.words(2, 12).capitalize()}</h1>"
        parts = [r.choice([title, title, f"<header>{title}</header>", ""])]
        for _ in range(r.choice([1, 2, 3, 5, 8, 13, 21])):
            end = r.choice(["", "."])
            parts.append(r.choices(
                [f"<p>{self.sentences(1, 9)}</p>", f"<p><b>{self.sentences(1, 3)}<br><p>{self.sentences(1, 4)}</p>", f"<h2>{self.words(1, 6)}</h2>",
                 "<ul>" + "".join(f"<li>{self.words(2, 12)}{end}</li>" for _ in range(r.randint(2, 5))) + "</ul>", f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>",
                 f"<table><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 2)}</td></tr></table>", f"<div><p>{self.sentences(1, 4)}</p></div>",
                 f'<p>{self.sentences(1, 2)} <a href="/x">{self.words(1, 4)}</a> {self.sentences(1, 2)}</p>', f"<p>{self.words(1, 2)}.</p>",
                 f"<figure><img src=x><figcaption>{self.words(2, 9)}</figcaption></figure>", f"<pre>{self.words(2, 20)}</pre>", self.sentences(1, 4)],
                weights=[14, 2, 2, 3, 1, 0.5, 1, 3, 2, 0.7, 0.5, 1],
            )[0])
            if r.random() < 0.03:
                parts.append(self.region(r.choice(["advert", "sidebar", "form"])))
        return "".join(parts)

    def page(self) -> str:
        r = self.r
        before = [k for k in ("notice", "header", "menu", "advert", "menu", "form") if r.random() < (0.6 if k == "header" else 0.4)]
        after = [k for k in ("comments", "sidebar", "sidebar", "advert", "form", "notice") if r.random() < 0.3] + ["footer"] * (r.random() < 0.8)
        bare = r.random() < 0.03  # the article lies directly in the body
        article = self.article() if bare else self.element("content", self.article(), "c")
        body = "".join(map(self.region, before)) + article + "".join(map(self.region, after))
        if not bare and r.random() < 0.35:
            body = f"<div{self.names('wrapper')}>{body}</div>"
        if r.random() < 0.1:
            body = body[: r.randint(len(body) // 2, len(body))]
        return f"<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body{f' {MARK}="c"' if bare else ""}>{body}</body></html>"
