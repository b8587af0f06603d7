"""Labelled pages for HTML extraction: what a reader came for stands between <content> and </content>.

The pages are built by rule from a fixed seed, so that every layout occurs in many mixtures: content as
paragraphs, divisions, lists, tables, quotes, code, figures and definitions, in articles, sections, bare
divisions or table cells; around it menus, link lists, teasers, notices, footers, forms and comments, with
and without elements or names that say what they are.
"""

from __future__ import annotations

import random
from functools import lru_cache

#: Pages, and the seed that they are built from.
PAGES, SEED = 240, 20240607
SYLLABLES = "ka lo mi ten ra su vor eli gan po ter wi nu sha del or in ex pra".split()


def words(r: random.Random, least: int, most: int) -> str:
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(least, most)))


def linked(r: random.Random, least: int = 1, most: int = 3) -> str:
    return f"<a href='/{r.choice(SYLLABLES)}'>{words(r, least, most)}</a>"


def sentence(r: random.Random) -> str:
    parts = [words(r, 4, 14)]
    for _ in range(r.randint(0, 2)):
        tag = r.choice(("b", "em", "i", "span", "strong", "code", "a", "a"))
        parts += [f"<{tag}>{words(r, 1, 3)}</{tag}>", words(r, 2, 9)]
    if r.random() < 0.15:
        parts.append("<br>" + words(r, 3, 9))
    return " ".join(parts) + "."


def paragraph(r: random.Random, tag: str) -> str:
    return f"<{tag}>{' '.join(sentence(r) for _ in range(r.choice((1, 1, 2, 3))))}</{tag}>"


def content_part(r: random.Random, paragraph_tag: str) -> str:
    kind = r.random()
    if kind < 0.55:
        return paragraph(r, paragraph_tag)
    if kind < 0.65:
        return f"<h{r.choice('234')}>{words(r, 1, 6)}</h2>".replace("</h2>", "</h3>" if r.random() < 0.1 else "</h2>")
    if kind < 0.77:
        tag = r.choice(("ul", "ol"))
        return f"<{tag}>" + "".join(
            f"<li>{words(r, 1, 12) if r.random() < 0.8 else linked(r, 2, 5)}</li>" for _ in range(r.randint(2, 9))
        ) + f"</{tag}>"
    if kind < 0.87:
        columns = r.randint(2, 4)
        row = lambda tag: "<tr>" + "".join(f"<{tag}>{words(r, 1, 4)}</{tag}>" for _ in range(columns)) + "</tr>"
        return "<table>" + row("th") + "".join(row("td") for _ in range(r.randint(2, 12))) + "</table>"
    if kind < 0.92:
        return f"<blockquote>{paragraph(r, 'p')}</blockquote>"
    if kind < 0.96:
        return f"<figure><img src='x'><figcaption>{words(r, 3, 9)}</figcaption></figure>"
    return f"<pre>{words(r, 6, 20)}</pre>" if kind < 0.98 else f"<dl><dt>{words(r, 1, 2)}</dt><dd>{words(r, 4, 12)}</dd></dl>"


def other_part(r: random.Random) -> str:
    """Something around the content, half of the time without a name that says so."""
    links = lambda tag: "".join(f"<{tag}>{linked(r)}</{tag}>" for _ in range(r.randint(3, 9)))
    kind, named = r.randrange(8), r.random() < 0.5
    if kind == 0:
        return f"<nav><ul>{links('li')}</ul></nav>" if named else f"<div><ul>{links('li')}</ul></div>"
    if kind == 1:
        return f"<footer><p>{words(r, 2, 8)}</p></footer>" if named else f"<div>{words(r, 1, 4)} {linked(r)}</div>"
    if kind == 2:
        return f"<div class='ad'>{words(r, 3, 12)}</div>" if named else f"<div><img src='x'>{linked(r, 2, 5)}</div>"
    if kind == 3:
        return f"<aside><h3>{words(r, 1, 3)}</h3>{links('p')}</aside>" if named else f"<div><h3>{words(r, 1, 3)}</h3>{links('div')}</div>"
    if kind == 4:
        return f"<form><label>{words(r, 1, 3)}</label><input><button>{words(r, 1, 1)}</button></form>" if named else f"<p>{' | '.join(linked(r) for _ in range(r.randint(2, 6)))}</p>"
    if kind == 5:
        return f"<div class='notice'><p>{words(r, 5, 16)}</p></div>" if named else f"<table><tr>{links('td')}</tr></table>"
    if kind == 6:
        return f"<section id='comments'><h3>{words(r, 1, 2)}</h3>" + "".join(
            f"<div><p>{words(r, 3, 20)}</p></div>" for _ in range(r.randint(1, 6))
        ) + "</section>"
    return f"<header>{linked(r)}<p>{words(r, 1, 6)}</p></header>" if named else f"<div><span>{words(r, 1, 2)}</span><div>{linked(r)}</div><div>{linked(r)}</div></div>"


def page(r: random.Random) -> str:
    tag = r.choice(("p", "p", "p", "div"))
    parts = [f"<h1>{words(r, 2, 9)}</h1>"] if r.random() < 0.8 else []
    top = f"<header>{''.join(parts)}<p>{words(r, 3, 12)}</p></header>" if r.random() < 0.2 else None
    for _ in range(r.randint(2, 10)):
        parts.append(content_part(r, tag))
    if top:
        parts[0] = top
    elif r.random() < 0.25:
        parts = [f"<div>{p}</div>" for p in parts]
    before, after = ("".join(other_part(r) for _ in range(r.randint(1, 4))) for _ in range(2))
    open_, close = r.choice(
        (
            ("<article>", "</article>"), ("<main>", "</main>"), ("<div class='main'>", "</div>"),
            ("<section><div>", "</div></section>"), ("<table><tr><td>", "</td></tr></table>"), ("", "")
        )
    )
    if top:
        open_, close = "<article>", "</article>"
    return f"<html><head><meta charset='utf-8'><title>t</title></head><body>{before}{open_}<content>{''.join(parts)}</content>{close}{after}</body></html>"


@lru_cache(maxsize=1)
def labelled_pages(n: int = PAGES, seed: int = SEED) -> tuple[str, ...]:
    r = random.Random(seed)
    return tuple(page(r) for _ in range(n))
