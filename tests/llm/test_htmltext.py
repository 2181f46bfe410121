"""Extraction: the distribution against a plain count, shapes of pages, broken pages."""

import random
import time

import numpy as np
import pytest

from siltstone.llm.htmltext import main_text, noise_token, runs_of
from tests.llm.conftest import prose

P = lambda k, n=30: f"<p>{prose(k, n)}</p>"


def runs_by_hand(weights, window):
    """Every line is in a run if a window around it weighs something and it lies between lines with weight."""
    out, start, last = [], None, None
    for i, w in enumerate(weights):
        if w:
            if start is None or sum(weights[i - window : i]) == 0 and i - last > window:
                if start is not None:
                    out.append((start, last + 1))
                start = i
            last = i
    if start is not None:
        out.append((start, last + 1))
    peaks = [max(sum(weights[max(k, a) : min(k + window, b)]) for k in range(a - window + 1, b)) for a, b in out]
    return [(a, b, p) for (a, b), p in zip(out, peaks, strict=True)]


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_surge_and_dive_against_brute_force(window):
    rng = random.Random(window)
    for _ in range(300):
        weights = [rng.choice([0, 0, 0, rng.randrange(1, 50)]) for _ in range(rng.randrange(0, 30))]
        assert runs_of(np.array(weights, dtype=np.int64), window) == runs_by_hand(weights, window)


def test_class_words():
    assert [noise_token(t) for t in ("sidebar", "Site-Footer", "has-sidebar", "comments-open", "main", "ad", "adapter", "cookie-banner", "no-comments")] == [2, 1, 0, 0, 0, 2, 0, 1, 0]


def test_wrappers_named_after_what_they_hold():
    body = P(1) + P(2)
    want = f"{prose(1, 30)} {prose(2, 30)}"
    assert main_text(f'<div class="layout has-sidebar"><article>{body}</article><div class="sidebar">{P(3, 90)}</div></div>') == want
    assert main_text(f'<div class="post comments-open"><article>{body}</article><div id="comments">{P(3, 90)}</div></div>') == want
    assert main_text(f'<div class="banner-page"><main>{body}</main></div>') == want
    assert main_text(f'<form id="page"><div>{body}<input></div></form>') == want


def test_closing_paragraph_after_an_advert():
    page = f"<body><div class='menu'><a>x</a></div><div>{P(1, 80)}{P(2, 80)}<div class='ad'>Buy</div><p>The end.</p></div></body>"
    assert main_text(page) == f"{prose(1, 80)} {prose(2, 80)} The end."


def test_short_article_beside_the_main_text():
    page = f"<body><article>A teaser.</article><section><div id='main'>{P(1, 80)}{P(2, 80)}</div></section></body>"
    assert main_text(page).endswith(f"{prose(1, 80)} {prose(2, 80)}")


def test_lists_of_links_are_dives():
    links = "<ul>" + "".join(f"<li><a href=/{k}>{prose(k, 3)}</a></li>" for k in range(8)) + "</ul>"
    assert main_text(f"<div><div>{links}</div></div><div><div>{P(1, 60)}</div></div>") == prose(1, 60)
    assert main_text(f"<article>{P(1)}{links}{P(2)}</article>") == f"{prose(1, 30)} {prose(2, 30)}"


def test_header_within_an_article():
    page = f"<article><header><h1>Title</h1><p>By a writer</p><button>Share</button></header>{P(1)}<footer>Tags</footer></article>"
    assert main_text(page) == f"Title {prose(1, 30)}"


BROKEN = ['<div class="x ', "</div></p></b>", "<b><div>", "<a href='x\" ", "<", "<!-- ", '<p a="b', "<script>", '<div class="ad"><p>x', "</article>", "<li><a>", "&amp", '<div class="ad" id=']


@pytest.mark.parametrize("piece", BROKEN)
def test_broken_pages_take_time_in_proportion(piece):
    def took(size):
        page = f"<article>{P(1)}</article>" + piece * (size // len(piece))
        began = time.perf_counter()
        main_text(page)
        return time.perf_counter() - began

    assert took(1_000_000) < 8
    assert main_text(f"{P(1)}<b>open") == f"{prose(1, 30)} open"
