"""Properties of the pure parts, on generated input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat, decontaminate, html_text, quality, simhash, warc

WORDS = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30)


@settings(deadline=None, max_examples=150)
@given(st.lists(WORDS.filter(bool), max_size=5), WORDS, st.integers(1, 6))
def test_automaton_equals_search(items, text, window):
    sam = decontaminate.SuffixAutomaton([(str(i), ws) for i, ws in enumerate(items)], window)
    hit, found = set(), set()
    for name, ws in enumerate(items):
        k = min(window, len(ws))
        grams = {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)}
        for i in range(len(text) - k + 1):
            if tuple(text[i:i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(str(name))
    spans, names = sam.scan(text)
    assert {p for a, b in spans for p in range(a, b)} == hit and names == found
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


@settings(deadline=None)
@given(st.text(max_size=200), st.integers(1, 40))
def test_chunks(text, size):
    assert warc.dechunked(warc.chunked(text.encode("utf-8", "ignore"), size)) == text.encode("utf-8", "ignore")


@settings(deadline=None)
@given(st.text(alphabet="<|\\a\n", max_size=30))
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text and chat.unescape_role(chat.escape_role(text)) == text and "<|" not in chat.escape(text)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=6), st.lists(st.tuples(st.integers(0, 5), st.lists(st.integers(0, 63), max_size=5)), max_size=40), st.integers(0, 6))
def test_trie_join_equals_all_pairs(seeds, edits, budget):
    prints = set(seeds)
    for k, bits in edits:
        p = seeds[k % len(seeds)]
        for b in bits:
            p ^= 1 << b
        prints.add(p)
    v = np.array(sorted(prints), dtype=np.uint64)
    got = simhash.trie_join(v, np.array([[0, len(v), 0, len(v)]]), budget, leaf=4, at_once=7)
    want = np.arange(len(v))
    for i in range(len(v)):
        near = want[np.bitwise_count(v ^ v[i]) <= budget]
        want[np.isin(want, near)] = near.min()
    assert (got == want).all()


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<a href=x>", "</a>", "<ul><li>", "<table><tr><td>", "</table>", "<nav>", "</nav>", "<!--", "-->", "<script>", "</script>", "text, and more of it to read here. ", "&amp;", "<b", ">", "\"", "<br>", "<article>", "</article>", "<h1>T</h1>"]), max_size=40))
def test_html_never_fails(parts):
    out = html_text.main_text("".join(parts))
    assert out == out.strip() and "\n\n\n" not in out


@settings(deadline=None)
@given(st.lists(st.sampled_from([b"x", b"y", b"z"]), max_size=40))
def test_repeat_words(words):
    from collections import Counter

    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    want = {k for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    assert quality.repeat_words(words, Counter(words)) == len(want)
