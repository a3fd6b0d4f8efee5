"""Dropped elements inside a paragraph."""

import random

import numpy as np
import pytest

from stringloom.llm.html_extract import Lines, main_text


@pytest.mark.parametrize("drop", ["<script>f()</script>", "<button>b</button>", "<button><div>b</div></button>", "<svg><text>b</text></svg>", "<span class=ad>b</span>", "<style>p{}</style>"])
def test_text_before_an_inline_dropped_element_stays(drop):
    assert main_text(f"<article><p>Intro {drop}rest</p><p>next</p></article>") == "Intro rest\nnext"


def test_text_before_an_element_that_never_closes_stays():
    assert main_text("<article><p>Intro <span class=ad>b</p></article>") == "Intro"
    assert main_text("<p>Intro <span class=ad>b") == "Intro"


def test_a_story_outside_the_only_article_is_kept():
    story = "".join(f"<p>{'A long sentence of the story goes on. ' * 8}{i}</p>" for i in range(8))
    text = main_text(f"<body><div>{story}</div><article class=teaser><a href=x>Read more</a></article></body>")
    assert text.count("long sentence") == 64


@pytest.mark.parametrize("name", ["class=notice-board", "id=ad-hoc", "class='related-work'", "class=commentary"])
def test_names_that_also_say_something_else_drop_nothing(name):
    assert main_text(f"<article><p {name}>Intro</p><p>next</p></article>") == "Intro\nnext"


@pytest.mark.parametrize("name", ["class='box cookie-notice'", "id=cookieNotice", "class=comments-list", "class=ad-slot-2", "role=navigation", "class=siteFooter"])
def test_names_that_say_nothing_else_drop_their_element(name):
    assert main_text(f"<article><p>Intro</p><div {name}>no</div><p>next</p></article>") == "Intro\nnext"


def brute_regions(lines, named):
    """Regions chosen from (characters, tags, region, kept) lines, computed anew from the description."""
    ratio = np.log1p([n / max(1, tags) for n, tags, *_ in lines])
    at = np.arange(len(lines))
    weight = np.exp(-((at[:, None] - at) ** 2) / (2 * 1.5**2)) * (abs(at[:, None] - at) <= 4)
    score = weight @ ratio / weight.sum(axis=1) + np.array([1.5 * (r in named) for *_, r, _ in lines])
    mine = score[[k for *_, k in lines]]
    low, high = mine.min(), mine.max()
    for _ in range(16):
        upper = mine >= (low + high) / 2
        if upper.all():
            break
        if (mine[~upper].mean(), mine[upper].mean()) == (low, high):
            break
        low, high = mine[~upper].mean(), mine[upper].mean()
    return {r for (*_, r, keep), x in zip(lines, score, strict=True) if keep and x >= (low + high) / 2}


def test_scores_against_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        parts = []
        for _ in range(rng.randint(1, 9)):
            tag = rng.choice(["div", "div", "section", "article", "main", "nav", "ul"])
            own = "".join(f"<{x}>{'word ' * rng.choice([1, 3, 40])}{'<a>l</a>' * rng.choice([0, 0, 6])}</{x}>" for x in rng.choices(["p", "li", "h2"], k=rng.randint(1, 5)))
            parts.append(f"<{tag}>{own}</{tag}>")
        html = "<body>" + "".join(parts)
        page = Lines()
        page.feed(html)
        page.close()
        page.flush()
        if not any(keep for *_, keep in page.lines):
            assert main_text(html) == ""
            continue
        chosen = brute_regions([(len(t), n, r, keep) for t, n, r, keep in page.lines], page.named)
        assert chosen and main_text(html) == "\n".join(t for t, _, r, keep in page.lines if keep and r in chosen)


def test_a_bare_article_does_not_decide_alone():
    """The ratios decide on pages with an article, too."""
    story = "".join(f"<p>{'A long sentence of the story goes on. ' * 20}{i}</p>" for i in range(9))
    card = "<article>" + "".join(f"<a href=x>{k}</a>" for k in range(9)) + "</article>"
    text = main_text(f"<body>{card}<div>{story}</div><nav>m</nav>")
    assert text.count("long sentence") == 180 and "012345678" not in text
