"""Nothing of a block or an attribute is cut off before it is looked at."""

from annolake.llm import html_extract
from annolake.llm.html_blocks import blocks


def boilerplate(html):
    return [any(str(f) == "boilerplate word" for f in own) for own in html_extract.features(blocks(html))]


def test_a_word_late_in_a_block():
    assert boilerplate(f"<p>{'plain words ' * 60} cookie</p>") == boilerplate("<p>cookie</p>") == [True]


def test_a_word_late_in_an_attribute():
    (block,) = blocks(f'<p class="{" ".join(["a"] * 14)} sidebar">text</p>')
    assert "sidebar" in repr(block)
