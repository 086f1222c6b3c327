"""Small texts whose answer is known, for the operators that read texts and pages whole."""

import time

from quire.llm import pii
from quire.llm.html_extract import main_text


def test_addresses_in_words_and_long_secrets():
    forest, limits = pii.model()
    add = lambda t: [(t[a:b], k) for a, b, k, _ in pii.added_spans(t, pii.base_spans(t), forest, limits)]
    for said in ("jane (AT) example.com", "jane [At] example Dot com", "jane at example.com"):
        assert (said, "email_words") in add(f"Please write to {said} today")
    assert add("look at this. Then we go") == add("We look at that.\nThen we go") == []
    secret = "b44e15e09f!d311c3cf31" * 20
    assert (secret) in [t for t in (f"token = {secret} x"[a:b] for a, b, _ in pii.candidates(f"token = {secret} x"))]


def test_page_text_is_neither_lost_nor_polluted():
    page = "<article><p>one <svg viewBox='0 0 1 1'/> two <math/> three <math><mi>x</mi></math> four</p><p>five</p></article>"
    assert main_text(page) == "one two three x four five"
    assert main_text("<article><p>one <svg><path d='m'> two</p><iframe src=a><p>three</p></article>") == "one two three"
    assert main_text("<article><p>one <svg><text>no</text></svg> two</p></article>") == "one two"
    assert main_text(f'<article><p title="{"a > b " * 3000}">one</p></article>') == "one"
    began = time.time()
    main_text("<svg>x" * 50_000)
    assert time.time() - began < 20
