"""Names of containers that frame a page do not delete its article; those of boilerplate do."""

import pytest

from examlake.llm import html

TEXT = [f"Paragraph {i} tells of the rivers and hills of the land, and of those who have lived there for long." for i in range(5)]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
WEIGHT = {"p": -0.5, "/p": -0.5, "div": -1.0, "/div": -1.0}
FRAMES = ['<div class="page has-sidebar">', '<div class="layout with-sidebar">', '<div class="no-ads content">', '<div class="post comments-open">', '<div class="related-work">', '<div class="social-science">', '<div class="share-page">', '<div class="banner-page">', '<form id="aspnetForm">', '<div class="widget">', '<div id="sidebar">']


@pytest.mark.parametrize("article", [True, False])
@pytest.mark.parametrize("frame", FRAMES)
def test_frames_stay(frame, article):
    end = "</form>" if frame.startswith("<form") else "</div>"
    page = f"<html><body><nav><a>Home</a></nav>{frame}<div>{'<article>' if article else ''}{BODY}{'</article>' if article else ''}</div>{end}<footer>About us</footer></body></html>"
    assert html.main_text(page, WEIGHT) == "\n".join(TEXT)


@pytest.mark.parametrize("name", ["ad", "ad-box", "site-footer", "sidebar right", "main-nav", "cookie-consent", "promo", "related-posts", "newsletter_form", "comments", "comment-list", "share-buttons"])
@pytest.mark.parametrize("outer", ["<div>", '<div class="has-sidebar">', '<form id="aspnetForm">'])
def test_boilerplate_goes(name, outer):
    page = f"<body>{outer}" + "".join(f"<p>{t}</p>" for t in TEXT[:2]) + f'<div class="{name}"><p>Buy this now and tell all your friends of it.</p></div>' + "".join(f"<p>{t}</p>" for t in TEXT[2:]) + ("</form>" if outer.startswith("<form") else "</div>") + "</body>"
    assert html.main_text(page, WEIGHT) == "\n".join(TEXT)


def test_long_comments_go():
    """However much readers wrote, it is not the article."""
    page = f'<body><div>{BODY}</div><section class="comments">{"<p>I do not think that this is so, and I said it often enough.</p>" * 40}</section></body>'
    assert html.main_text(page, WEIGHT) == "\n".join(TEXT)
