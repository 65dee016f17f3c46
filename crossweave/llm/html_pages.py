"""Labelled pages to learn from: a fixed rule writes pages of many layouts, with what each block is.

The corpus has no labels for pages, so the layouts here stand for them: texts of one block to many in containers of
all kinds (or none), alone or with menus, headers, sidebars, notices, adverts, forms, comments and footers around and
inside them. Words are invented in several alphabets and any sentence may be odd (capitals, numbers, marks of all
sorts, repeats), so that what is learnt depends on layout and form rather than on a language.
"""

from __future__ import annotations

import random
import string
from collections.abc import Iterator

#: A marker before each block's text says what it is; the reader of the pages takes it off.
GOOD, BAD = "\x02", "\x03"

_ALPHABETS = ["ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu an er in on th".split(), "é à ün ße öl ña ço ís ært ğı łó ší".split(), "да не по что как это ра ми ко ль".split(), "の は を が 国 学 人 日 本 大".split()]
_MARKS = [c for c in string.punctuation if c not in "<>&"] + ["&amp;", "&lt;", "&hellip;", "&mdash;", "…", "–"]


class _Writer:
    """The text of one page."""

    def __init__(self, seed: int) -> None:
        self.rng = rng = random.Random(seed)
        syllables = rng.choice(_ALPHABETS[:1] * 3 + _ALPHABETS)
        self.vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(60)]
        self.odd = rng.choice([0.0, 0.0, 0.0, 0.1, 0.9])

    def words(self, low: int, high: int) -> list[str]:
        return self.rng.choices(self.vocabulary, k=self.rng.randint(low, high))

    def _distorted(self, words: list[str]) -> str:
        rng = self.rng
        way = rng.randrange(5)
        if way == 0:
            return f" {rng.choice(_MARKS)} ".join(words)
        if way == 1:
            return " ".join(w + rng.choice(_MARKS) * rng.randint(0, 4) for w in words)
        if way == 2:
            return " ".join(rng.choices(words[:2], k=rng.randint(2, 60)))
        if way == 3:
            return " ".join(words).upper()
        return " ".join(str(rng.randrange(10**6)) if rng.random() < 0.5 else w for w in words)

    def sentence(self, low: int = 4, high: int = 22) -> str:
        rng, words = self.rng, self.words(low, high)
        if rng.random() < self.odd:
            return self._distorted(words)
        text = " ".join(w + "," if rng.random() < 0.08 else w for w in words[:-1]) + " " + words[-1]
        return text.strip().capitalize() + rng.choice([".", ".", ".", "!", "?", ".&quot;", ".”"])

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))

    def title(self) -> str:
        words = self.words(1, 9)
        return self._distorted(words) if self.rng.random() < self.odd else " ".join(words).capitalize() + self.rng.choice(["", "", "", ".", "?"])

    def inline(self, text: str) -> str:
        """The text with some markup inside a line."""
        words = text.split(" ")
        for _ in range(self.rng.randint(0, 4)):
            i = self.rng.randrange(len(words))
            if "<" not in words[i]:
                words[i] = self.rng.choice(['<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "<strong>{}</strong>", '<span class="x">{}</span>', "<code>{}</code>", "{}<br>", "<math><mi>{}</mi></math>", "<object>{}</object>", "<canvas>{}</canvas>", "<u>{}"]).format(words[i])
        return " ".join(words)


def _tagged(w: _Writer, tags: str, names: list[str], inner: str, always: bool = False) -> str:
    """A box that has one of the names, or (unless ``always``) none."""
    tag, name = w.rng.choice(tags.split()), w.rng.choice(names)
    if not always and w.rng.random() < 0.3:
        return f"<{tag}>{inner}</{tag}>"
    name = w.rng.choice([name, name, f"{name} {''.join(w.words(1, 1))}", f"site-{name}", name.title().replace("-", "")])
    return f'<{tag} {w.rng.choice(["class", "class", "id"])}="{name}">{inner}</{tag}>'


def _aside_text(w: _Writer, mark: str = BAD) -> str:
    text = mark + w.inline(w.rng.choice([w.prose(1, 3), w.title()]))
    return w.rng.choice(["<p>{}</p>", "<div>{}</div>", "<span>{}</span>", "{}"]).format(text)


def _links(w: _Writer, low: int, high: int) -> str:
    items = [" ".join(w.words(1, 3)) for _ in range(w.rng.randint(low, high))]
    if w.rng.random() < 0.7:
        tag = w.rng.choice(["ul", "ol"])
        return f"<{tag}>" + "".join(f'<li><a href="/{i}">{BAD}{x}</a></li>' for i, x in enumerate(items)) + f"</{tag}>"
    return f"<div>{BAD}" + w.rng.choice([" ", " | ", " · "]).join(f'<a href="/{i}">{x}</a>' for i, x in enumerate(items)) + "</div>"


#: Names by which pages tell their parts apart.
ADVERTS = "ad ads advert advertisement ad-slot ad-box banner-ad sponsored sponsor promo promotion adsbygoogle".split()
NOTICES = "notice cookie cookie-banner cookies consent gdpr alert warning popup modal overlay paywall subscribe newsletter banner privacy".split()
SIDES = "sidebar side widget related recommended trending more popular rail aside tags share social teaser".split()
COMMENTS = "comments comment comment-list commentlist discussion responses replies reader-comments feedback".split()
MENUS = "nav menu navbar topnav breadcrumb breadcrumbs navigation pagination skip-link toc".split()
HEADERS = "header masthead top branding logo topbar".split()
FOOTERS = "footer bottom copyright legal colophon foot".split()
BODIES = "content main article post entry-content post-body story article-body text page-content entry body-text main-content".split()
FAMILIES = {"adverts": ADVERTS, "notices": NOTICES, "sides": SIDES, "comments": COMMENTS, "menus": MENUS, "headers": HEADERS, "footers": FOOTERS, "bodies": BODIES}
#: Names of wrappers, which say nothing of the text in them.
WRAPPERS = "wrapper container page layout app root has-sidebar no-sidebar with-menu sidebar-layout menu-open comments-open header-fixed single-post".split()


def _advert(w: _Writer) -> str:
    return _tagged(w, "div div aside section ins p", ADVERTS, "".join(_aside_text(w) for _ in range(w.rng.randint(1, 2))), True)


def _notice(w: _Writer) -> str:
    inner = _aside_text(w) + w.rng.choice(["", f"<button>{BAD}{w.title()}</button>"])
    return _tagged(w, "div div section aside dialog p", NOTICES, inner, True)


def _without_scripts(w: _Writer) -> str:
    return f"<noscript>{_aside_text(w)}</noscript>"


def _hidden(w: _Writer) -> str:
    return w.rng.choice(['<div style="display:none">{}</div>', "<div hidden>{}</div>", '<p aria-hidden="true">{}</p>']).format(BAD + w.prose(1, 2))


def _form(w: _Writer) -> str:
    fields = "".join(f"<label>{BAD}{w.title()}</label><input name=a>" for _ in range(w.rng.randint(1, 3)))
    options = "<select>" + "".join(f"<option>{BAD}{w.title()}" for _ in range(w.rng.randint(1, 4))) + "</select>"
    return f'<form action="/{w.rng.choice(["search", "login", "signup"])}">{w.rng.choice([_aside_text(w), ""])}{fields}{w.rng.choice([options, "<textarea>zu</textarea>", ""])}<button>{BAD}{w.title()}</button></form>'


def _sidebar(w: _Writer) -> str:
    head = w.rng.choice([f"<h{w.rng.randint(2, 4)}>{BAD}{w.title()}</h3>", ""])
    inner = head + w.rng.choice([_links(w, 2, 8), _aside_text(w)])
    return _tagged(w, "aside", SIDES, inner) if w.rng.random() < 0.5 else _tagged(w, "div section", SIDES, inner, True)


def _comments(w: _Writer) -> str:
    one = w.rng.choice(["<li>{}</li>", "<li>{}</li>", '<div class="comment">{}</div>', '<article class="comment">{}</article>', '<div class="reply"><p>{}</p></div>', "<p>{}</p>"])
    items = "".join(one.format(BAD + w.prose(1, 3)) for _ in range(w.rng.randint(1, 6)))
    return _tagged(w, "section div ol aside", COMMENTS, w.rng.choice([f"<h3>{BAD}{w.title()}</h3>", ""]) + items, True)


def _menu(w: _Writer) -> str:
    inner = _links(w, 2, 9)
    return f"<nav>{inner}</nav>" if w.rng.random() < 0.6 else _tagged(w, "div ul", MENUS, inner, True)


def _header(w: _Writer) -> str:
    inner = w.rng.choice([f"<h1>{BAD}{w.title()}</h1>", _aside_text(w), f'<a href="/">{BAD}{w.title()}</a>']) + w.rng.choice(["", _menu(w)])
    return f"<header>{inner}</header>" if w.rng.random() < 0.6 else _tagged(w, "div", HEADERS, inner, True)


def _footer(w: _Writer) -> str:
    inner = w.rng.choice([f"{BAD}&copy; {w.rng.randint(1990, 2030)} {w.title()} &middot; {w.prose(1, 2)}", _links(w, 2, 6), _aside_text(w)])
    return f"<footer>{inner}</footer>" if w.rng.random() < 0.7 else _tagged(w, "div", FOOTERS, inner, True)


def _main_block(w: _Writer) -> str:
    kind, text = w.rng.random(), GOOD + w.inline(w.prose())
    if kind < 0.6:
        return w.rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", '<p class="x">{}</p>', "<div>{}</div>"]).format(text)
    if kind < 0.68:
        return f"<p>{GOOD}{' '.join(w.words(1, 5)).capitalize()}{w.rng.choice(['', '.', ':'])}</p>"
    if kind < 0.78:
        level = w.rng.randint(1, 5)
        return f"<h{level}>{GOOD}{w.title()}</h{level}>"
    if kind < 0.86:
        tag = w.rng.choice(["ul", "ol"])
        return f"<{tag}>" + "".join(f"<li>{GOOD}{w.inline(w.sentence(2))}</li>" for _ in range(w.rng.randint(2, 5))) + f"</{tag}>"
    if kind < 0.9:
        return w.rng.choice(["<blockquote><p>{}</p></blockquote>", "<blockquote>{}</blockquote>"]).format(text)
    if kind < 0.94:
        return "<table>" + "".join(f"<tr><td>{GOOD}{w.title()}<td>{GOOD}{w.sentence()}</tr>" for _ in range(w.rng.randint(1, 4))) + "</table>"
    return w.rng.choice([f"<figure><img src=x><figcaption>{GOOD}{w.sentence()}</figcaption></figure>", f"<pre>{GOOD}{w.sentence()}</pre>", f"<noscript>{text}</noscript>", f"<dl><dt>{GOOD}{w.title()}<dd>{GOOD}{w.sentence()}</dl>"])


def _text(w: _Writer, n: int, inside: bool) -> str:
    """The main text of n parts, with other things in it if ``inside``."""
    if w.rng.random() < 0.15:  # parted by line breaks alone
        return GOOD + "<br><br>".join(w.inline(w.prose()) for _ in range(n))
    parts = [_main_block(w) for _ in range(n)]
    if inside:
        for make in (_advert, _notice, _sidebar, _form, _hidden):
            if w.rng.random() < 0.3:
                parts.insert(w.rng.randrange(len(parts) + 1), make(w))
    return "".join(parts)


def _table_layout(w: _Writer, name: str, text: str) -> str:
    row = lambda names: f'<tr><td colspan="2" class="{w.rng.choice(names)}">{_aside_text(w)}</td></tr>' if w.rng.random() < 0.6 else ""
    return f'<table>{row(HEADERS)}<tr><td class="{w.rng.choice(MENUS + SIDES)}">{_links(w, 2, 6)}</td><td class="{name}">{text}</td></tr>{row(FOOTERS)}</table>'


def page(seed: int) -> str:
    """A page whose blocks start with ``GOOD`` or ``BAD``."""
    w = _Writer(seed)
    rng = w.rng
    some = lambda make, chance: make(w) if rng.random() < chance else ""
    bare = rng.random() < 0.25
    heading = rng.choice([f"<h1>{GOOD}{w.title()}</h1>"] * 2 + [f"<header><h1>{GOOD}{w.title()}</h1></header>", "", ""])
    text = heading + _text(w, rng.choice([1, 2, 3, rng.randint(4, 25)]), not bare)
    late = "" if bare else some(_sidebar, 0.2) + some(_comments, 0.3) + some(_footer, 0.1)
    inside = rng.random() < 0.5
    text += late if inside else ""
    name = rng.choice(BODIES)
    body = rng.choice(
        [
            f"<article>{text}</article>",
            f"<article>{text}</article>",
            f"<main>{text}</main>",
            f'<main><article class="{name}">{text}</article></main>',
            f'<div class="{name}">{text}</div>',
            f"<div class={name}>{text}</div>",
            f'<div id="{name}">{text}</div>',
            f'<section class="{name}">{text}</section>',
            f'<div role="main">{text}</div>',
            f"<div>{text}</div>",
            text,
            text if bare else _table_layout(w, name, text),
        ]
    )
    if bare:
        return rng.choice(["{}", "<body>{}", "<html><head><title>a</title><body>{}</body></html>", "<html><head><meta name=x content=y>{}"]).format(body)
    before = some(_notice, 0.3) + some(_header, 0.5) + some(_menu, 0.7) + some(_form, 0.15) + some(_advert, 0.4) + some(_sidebar, 0.15) + some(_hidden, 0.1) + some(_without_scripts, 0.1)
    after = ("" if inside else late) + some(_advert, 0.25) + some(_sidebar, 0.35) + some(_form, 0.2) + some(_comments, 0.2) + some(_notice, 0.15) + some(_footer, 0.8)
    names = " ".join(rng.sample(WRAPPERS, 2))
    wrap = rng.choice(["{}", "{}", f'<div class="{names}">{{}}</div>', f'<div id="{rng.choice(WRAPPERS)}"><div class="{names}">{{}}</div></div>'])
    return f"<!DOCTYPE html><html><head><title>{w.title()}</title></head><body class=\"{rng.choice([names, ''])}\">" + wrap.format(before + body + after) + "</body></html>"


def pages(n: int) -> Iterator[str]:
    return (page(seed) for seed in range(n))
