"""Main text of generated pages whose text is known, path scores against a slow version, and a table of odd pages."""

import random

import numpy as np
import pytest

from textward.llm import html_extract
from textward.llm.html_extract import extract, main_text

WORDS = "one other place water people story number house after under little every never again while along thing world".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + rng.choice([".", "!", "?"])


def paragraph(rng):
    return " ".join(sentence(rng, rng.randint(5, 14)) for _ in range(rng.randint(2, 5)))


def page(seed):
    """Page and its main text."""
    rng = random.Random(seed)
    parts, want = [], []

    def add(tag, text, inner=None):
        parts.append(f"<{tag}>{inner or text}</{tag.split()[0]}>")
        want.append(text)

    add("h1", sentence(rng, 5))
    for k in range(rng.randint(3, 9)):
        kind = rng.choice(["p", "p", "p", "h2", "list", "quote", "table", "sources"])
        if kind in ("p", "quote"):
            add("p" if kind == "p" else "blockquote", paragraph(rng))
        elif kind == "h2":
            add('h2 id="part"', sentence(rng, 3))
        elif kind == "list":
            items = [sentence(rng, 4) for _ in range(3)]
            parts.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
            want.extend(items)
        elif kind == "table":
            cells = [sentence(rng, 2) for _ in range(4)]
            parts.append("<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in zip(cells[::2], cells[1::2], strict=True)) + "</table>")
            want.extend(cells)
        else:
            title = sentence(rng, 4)
            add("p", f"{sentence(rng, 9)} {title} {sentence(rng, 6)}")
            parts[-1] = parts[-1].replace(title, f"<a href=/s>{title}</a>")
    body = "".join(parts)
    menu = lambda: "<ul>" + "".join(f"<li><a href=/{k}>{rng.choice(WORDS)}</a></li>" for k in range(5)) + "</ul>"
    noise = [
        f"<nav>{menu()}</nav>", f'<div class="menu">{menu()}</div>', f"<aside>{paragraph(rng)}</aside>", f'<div class="cookie-notice"><p>{paragraph(rng)}</p></div>', f"<footer><p>{paragraph(rng)}</p></footer>",
        f'<div class="ad"><p>{paragraph(rng)}</p></div>', f"<form><p>{sentence(rng, 5)}</p><input></form>", f"<script>var a = '<p>{sentence(rng, 5)}</p>';</script>", f'<div class="sidebar"><div>{menu()}</div></div>', f"<div>{menu()}</div>",
    ]
    before, after = rng.sample(noise, 3), rng.sample(noise, 3)
    comments = f'<section id="comments" class="comments"><p>{paragraph(rng)}</p></section>'
    wrap = ["<article>{}</article>", "<main><div>{}</div></main>", '<div class="page"><div class="story">{}</div></div>', "<div><article><div>{}</div></article></div>", '<div id="wrapper"><section>{}</section></div>'][seed % 5]
    return f"<html><head><title>T</title></head><body>{''.join(before)}{wrap.format(body)}{comments}{''.join(after)}</body></html>", want


@pytest.mark.parametrize("seed", range(60))
def test_generated_pages(seed):
    source, want = page(seed)
    assert extract(source).split("\n\n") == want


def slow_scores(p, blocks, boilerplate):
    chain = lambda k: [k, *chain(p.above[k])] if k >= 0 else []
    marks = lambda b: len(html_extract.PUNCTUATION.findall(b[1])) if b[2] < html_extract.LINKS * len(b[1]) else 0
    size = lambda b: len(b[1]) - (1 - html_extract.LINKED) * b[2]
    live = [(p.path[b[0]], b) for b, off in zip(blocks, boilerplate, strict=True) if not off]
    mean = lambda f, own: sum(map(f, own)) / len(own) if own else 0.0
    out = []
    for b, off in zip(blocks, boilerplate, strict=True):
        at, ratios = p.path[b[0]], []
        for f in (size, marks):
            own = mean(f, [x for k, x in live if k == at])
            steps = [mean(f, [x for k, x in live if s in chain(k)]) for s in chain(at) if p.ends[s] not in ("", "html", "body")]
            ratios.append((own + sum(steps) / len(steps)) / 2 if steps else own)
        out.append(0.0 if off else ratios[0] * (1 + ratios[1]))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_path_scores_against_a_slow_version(seed):
    p = html_extract._Page(page(seed)[0])
    off = html_extract._dropped(p)
    assert np.allclose(html_extract.path_scores(p, p.blocks, off), slow_scores(p, p.blocks, off))


def bare_page(seed):
    """A page whose menu, tagline, further links and footer bear no names, and whose text stands in no article; and its text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice([".", ".", ".", "!", "?"])
    name = lambda: f' class="{word()}{rng.randrange(9)}"' if rng.random() < 0.6 else ""
    para = lambda: " ".join(sentence(rng.randrange(6, 16)) for _ in range(rng.randrange(2, 5)))
    title = sentence(4).rstrip(".!?")
    said = [title]
    body = f"<h1>{title}</h1>"
    for _ in range(rng.randrange(3, 9)):
        if rng.random() < 0.2:
            said.append(sentence(3).rstrip(".!?"))
            body += f"<h2>{said[-1]}</h2>"
        p = para()
        said.append(p)
        k = rng.randrange(4)
        body += f"<p{name()}>{p}</p>" if k else f"<p><b>{p.split(' ')[0]}</b> {p.split(' ', 1)[1]}</p>"
    menu = "".join(f"<li><a href='/{k}'>{word()}</a></li>" for k in range(rng.randrange(3, 9)))
    top = rng.choice([f"<div{name()}><ul>{menu}</ul></div>", f"<div{name()}>" + " | ".join(f"<a href=/>{word()}</a>" for _ in range(6)) + "</div>", "<table><tr>" + "".join(f"<td><a href=/>{word()}</a></td>" for _ in range(5)) + "</tr></table>"])
    line = f"<div{name()}><span>{sentence(4)}</span></div>" if rng.random() < 0.6 else ""
    side = f"<div{name()}><div>{word()} {word()}</div><div><a href=/>{sentence(5)}</a></div><div><a href=/>{sentence(4)}</a></div></div>" if rng.random() < 0.5 else ""
    foot = f"<div{name()}><small>Copyright {rng.randrange(1990, 2030)} {word()}</small> <a href=/>{word()}</a></div>"
    html = f"<html><head><title>{title}</title></head><body>{top}{line}<div{name()}>{body}</div>{side}{foot}</body></html>"
    return html, "\n\n".join(said)


def test_ratios_decide_where_nothing_is_named(monkeypatch):
    pages = [bare_page(k) for k in range(100)]
    assert all(extract(h) == text for h, text in pages)
    # with one score for every path that is not named as boilerplate, nothing tells text from menus
    monkeypatch.setattr(html_extract, "path_scores", lambda page, blocks, boilerplate: np.where(boilerplate, 0.0, 1.0))
    assert sum(extract(h) != text for h, text in pages) >= 90


def test_a_table_of_odd_pages(spark):
    long = "<article>" + "".join(f"<p>Paragraph {k}, of a very long page.</p>" for k in range(20_000)) + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>Text.</p>", "x"), (3, "u", "<p>Text.</p>", "x"), (3, "u", "<p>Text.</p>", "x"), (4, "u", "<nav><a>only</a></nav>", "x"), (5, "u", long, "x"), (6, "u", "<ul><li><a href=/>Just links</a></ul>", "x")]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = [(r.page_id, r.text if r.page_id != 5 else r.n_chars) for r in got.collect()]
    want = "\n\n".join(f"Paragraph {k}, of a very long page." for k in range(20_000))
    assert sorted(texts, key=repr) == sorted([(1, ""), (2, ""), (None, "Text."), (3, "Text."), (3, "Text."), (4, ""), (5, len(want)), (6, "")], key=repr)
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
