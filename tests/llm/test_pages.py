"""Pages whose names mislead: frames named like parts, page-wide forms, comments in articles, teasers; and a plain second reading of the region's choice."""

import random

import pytest

from weftgraph.llm import html_text
from weftgraph.llm.html_text import main_text

P = "<p>" + "This is the story text of a page that goes on for a while and says things. " * 4 + "</p>"
A = f"<article><h1>T</h1>{P * 3}</article>"
C = "<div class='comment'><p>" + "I disagree with this whole thing very much indeed. " * 9 + "</p></div>"

KEPT = {
    "wrapper": (f'<div class="wrapper with-sidebar">{A}</div>', "story text", ""),
    "has-header": (f'<div id="page" class="has-header">{A}</div>', "story text", ""),
    "ad-free": (f'<div class="ad-free x">{A}</div>', "story text", ""),
    "menu-review": (f'<div class="restaurant menu-review">{A}</div>', "story text", ""),
    "named like a part": (f'<div class="sidebar">{A}</div>', "story text", ""),
    "form": (f'<form id="aspnetForm">{A}</form>', "story text", ""),
    "form without article": (f'<form id="aspnetForm"><div id="nav"><a href=x>Home</a></div><div id="c">{P * 3}</div></form>', "story text", "Home"),
    "small form": (f"<article>{P}<form><p>Your mail</p></form>{P}</article>", "story text", "Your mail"),
    "section of comments": (f'<main><article>{P * 3}</article><section id="comments">{C * 9}</section></main>', "story text", "disagree"),
    "comments in the article": (f'<article>{P * 3}<section id="comments">{C * 2}</section></article>', "story text", "disagree"),
    "comment as article": (f'<article>{P * 2}</article><article class="comment"><p>disagree fully</p></article>', "story text", "disagree"),
    "teaser": (f'<div class="story">{P * 5}</div><article class="card"><h3>Other</h3><p>A teaser of another page.</p></article>', "story text", ""),
    "public notice": (f'<article>{P}<p class="public notice">A public notice was given.</p>{P}</article>', "public notice was", ""),
    "notice": (f'<article>{P}<div class="notice"><p>We use things</p></div>{P}</article>', "story text", "We use"),
    "social science": (f'<article>{P}<div class="social-science"><p>Social science says so.</p></div>{P}</article>', "Social science says", ""),
    "side and foot": (f'<div class="sidebar"><p>Side words</p></div><div class="footer-links"><p>Foot words</p></div>{A}', "story text", "words"),
    "shares": (f'<article>{P}<div class="share-buttons">Share it</div><div class="related-posts"><p>Other posts</p></div>{P}</article>', "story text", "Share it"),
    "comments open": (f'<div class="post comments-open">{P * 3}</div>', "story text", ""),
}


@pytest.mark.parametrize("name", KEPT)
def test_misleading_names(name):
    page, there, gone = KEPT[name]
    text = main_text(f"<html><body>{page}</body></html>")
    assert there in text and (not gone or gone not in text)


def test_named_parts():
    named = html_text._named
    assert [named(v, False, False) for v in ("sidebar", "site-header", "header-2", "ad_slot", "my comments", "gradient", "")] == ["part", "", "part", "part", "comments", "", ""]
    assert named("header", True, False) == "" and named("public notice", False, True) == "" and named("notice", False, True) == "part"


def region(lines):
    """The kept lines of (text, tags, linked, in core), written with plain lists."""
    import math

    ratio = [len(t) / max(1, n) for t, n, _, _ in lines]
    weight = [math.exp(-0.5 * d * d) for d in range(-3, 4)]
    smooth = [sum(w * ratio[min(len(ratio) - 1, max(0, i + d))] for d, w in zip(range(-3, 4), weight)) / sum(weight) for i in range(len(ratio))]
    mean = sum(smooth) / len(smooth)
    level = max(min(math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)), max(smooth)), min(10.0, max(smooth)))
    seed = [x >= level - 1e-9 for x in smooth]
    inside = sum(len(t) for (t, _, _, c), s in zip(lines, seed) if s and c)
    if inside and 2 * inside >= sum(len(t) for (t, _, _, _), s in zip(lines, seed) if s):
        return [t for t, _, _, c in lines if c]
    listy = [k > 0.5 * len(t) for t, _, k, _ in lines]
    keep = [s and not x for s, x in zip(seed, listy)]
    for step in (1, -1):  # from each kept line both ways to the next list of links
        order = range(len(lines)) if step > 0 else range(len(lines) - 1, -1, -1)
        for i in order:
            keep[i] = keep[i] or (not listy[i] and 0 <= i - step < len(lines) and keep[i - step])
    return [t for (t, _, _, _), k in zip(lines, keep) if k]


def test_region_against_a_second_reading():
    rnd = random.Random(6)
    for _ in range(300):
        lines, html = [], []
        for _ in range(rnd.randrange(1, 14)):
            words, link, core = " ".join("word" for _ in range(rnd.choice([1, 2, 9, 40]))), rnd.random() < 0.3, rnd.random() < 0.3
            extra = rnd.randrange(3)
            inner = "<i></i>" * extra + (f"<a>{words}</a>" if link else words)
            html.append(f"<article><div>{inner}</div></article>" if core else f"<div>{inner}</div>")
            lines.append([words, 0, len(words) if link else 0, core, 2 + 2 * extra + 2 * link + core, int(core)])
        # a block has the tags since the block before it, its own end tag included
        carry = 1
        for x in lines:
            x[1], carry = carry + x[4], x[5]
        want = region([tuple(x[:4]) for x in lines])
        assert main_text("<body>" + "".join(html)) == "\n\n".join(want)
