"""Elements of a page whose content is not text."""

from jostle.llm import html_tree


def shown(source):
    return " ".join(t for _, t in html_tree.parse(source).runs)


def test_text_after_skipped_elements_stays():
    long = "word " * 50
    assert shown("İ" * 300 + f"<script>var a;</SCRIPT ><p>{long}</p>").endswith(long.strip())
    assert shown('<p>a <svg width="1"/> b</p><p>c</p>') == "a b c"
    assert shown("<p>a <svg><text>x</text></svg> b</p>") == "a b"
    assert shown("<p>a <math><mi>x</mi></math> b</p>").split() == ["a", "x", "b"]
    for name in ("svg", "object", "canvas"):
        assert "rest" in shown(f"<p>a</p><{name} id='1'><p>rest</p>")
    assert shown("<p>a</p><script>rest") == "a"
