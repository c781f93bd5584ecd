"""Operators that judge each document: quality, language, HTML, chat, pieces."""

import hashlib
import itertools
import math
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bookpulse.llm import chat, html, langid, pieces, quality
from bookpulse.llm.common import table

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# Quality

def windows_twice(words, size):
    """Words in windows of a size that occur twice."""
    at = {}
    for k in range(len(words) - size + 1):
        at.setdefault(tuple(words[k : k + size]), []).append(k)
    return len({k + j for places in at.values() if len(places) > 1 for k in places for j in range(size)})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=5))
def test_repeats_by_brute_force(texts):
    limits = quality.Limits(base_window=2, repeat_words=4)
    got = list(quality.repeats([[w.encode() for w in words] for words in texts], limits))
    for words, (base, long, most) in zip(texts, got, strict=True):
        assert base == windows_twice(words, 2) and long == windows_twice(words, 4)
        assert most == max((n for n in range(1, len(words)) if windows_twice(words, n)), default=0)


def test_quality_of_odd_rows(spark, odd, none):
    report = quality.quality_report(odd)
    assert report.count() == odd.count() and quality.quality_report(none).count() == 0
    kept = {r.doc_id for r in report.where("kept").collect()}
    assert kept == {5, 6}
    good = quality.good_documents(odd)
    assert good.columns == odd.columns and {r.doc_id for r in good.collect()} == {5, 6}
    assert quality.good_documents(none).count() == 0


def test_long_repeats_are_refused():
    words = [f"w{k}" for k in range(2000)]
    clean = " ".join(words)
    twice = " ".join([*words, *words[:150]])
    assert [row[-1] for row in quality.judged([clean, twice])] == [True, False]


# Language

def test_profiles_and_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    learned = langid.profiles(docs.where(~test).select("lang", "text"))
    assert set(learned) == {"en", "de", "fr", "es"}
    said = langid.detect(docs.where(test), learned, [F.col("lang")]).collect()
    assert sum(r.lang == r.lang_pred for r in said) / len(said) > 0.98


def test_ranks_by_brute_force():
    text = "Über über, the THE a1b2 ñ"
    words = [["ü", "b", "e", "r"]] * 2 + [list("the")] * 2 + [["a"], ["b"], ["ñ"]]
    count = {}
    for word in words:
        for gram in word:
            count[gram] = count.get(gram, 0) + 1
        padded = [" ", *word, " "]
        for size in (2, 3):
            for k in range(len(padded) - size + 1):
                gram = "".join(padded[k : k + size])
                # A single letter between two spaces is one sequence of three; the space between words belongs to both.
                count[gram] = count.get(gram, 0) + 1
    found, n = langid.counted(langid.sequences(text))

    def spelt(value):
        out = []
        while value:
            out.append(chr(value & 0x1FFFFF))
            value >>= 21
        return "".join(reversed(out))

    got = dict(zip(map(spelt, found.tolist()), n.tolist(), strict=True))
    assert got == count


def test_out_of_place_distances_by_brute_force():
    rng = random.Random(4)
    size = 20
    learned = {f"l{k:04d}": np.array(rng.sample(range(60), rng.randint(1, size)), np.int64) + ord("a") for k in range(40)}
    postings = langid.Postings(learned)
    for _ in range(50):
        text = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 40)))
        own = langid.ranked(text, size).tolist()
        distance = {}
        for name, profile in learned.items():
            places = {s: k for k, s in enumerate(profile.tolist())}
            distance[name] = sum(abs(places[s] - k) if s in places else size for k, s in enumerate(own))
        want = min(distance, key=lambda name: (distance[name], name))
        got, score = langid.closest(text, postings, size)
        assert postings.names[got] == want and score == 1 - distance[want] / (size * len(own))


def test_thousands_of_languages(spark):
    rows = [(k, f"lang{k:05d}", " ".join(chr(0x4E00 + 7 * k + j) * 2 for j in range(5))) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    learned = langid.profiles(docs.select("lang", "text"))
    assert len(learned) == 3000
    said = langid.detect(docs, learned, [F.col("lang")])
    assert said.where("lang <> lang_pred").count() == 0


def test_language_of_odd_rows(spark, odd, none):
    learned = langid.profiles(odd.select("lang", "text"))
    assert set(learned) == {"en", "de"}
    said = langid.detect(odd, learned)
    assert said.count() == odd.count()
    assert {r.lang_pred for r in said.where("doc_id in (1, 2, 4)").collect()} == {"und"}
    assert {r.lang_pred for r in langid.detect(odd, langid.profiles(none.select("lang", "text"))).collect()} == {"und"}
    assert langid.detect(none, learned).count() == 0


# HTML

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li>One</li><li>Two</li></ul></nav>
<div class="cookie-notice">We use cookies.</div><aside>Side</aside>
<article class="post has-sidebar"><h1>A  title &amp; more</h1><p>First <b>bold</b>
paragraph&nbsp;here, long enough to count as text of the page.<p>Short.<div class="ad">Buy</div>
<form><input value="x"> Mail <button>Send</button></form><ul><li>item one<li>item two</ul>
<section id="comments"><p>A reader says a lot of things here, more than the article does, really a lot.</p></section>
</article><footer>&copy; me</footer></body></html>"""


def test_main_text():
    want = "A title & more\nFirst bold paragraph here, long enough to count as text of the page.\nShort.\nitem one\nitem two"
    assert html.main_text(PAGE) == want
    plain = PAGE.replace("<article", "<div").replace("</article>", "</div>")
    assert html.main_text(plain) == want
    assert html.main_text("") == "" and html.main_text("<p></p>") == ""
    assert html.main_text("just text") == "just text"
    assert html.main_text("<article><p>x") == "x"


def test_nested_and_several_articles():
    long = "A paragraph of the article that goes on and on for a good while. " * 6
    nested = f"<main><h1>Title</h1><article><p>{long}</p><p>{long}</p><p>{long}</p></article><p>short end</p></main><p>Outside</p>"
    assert html.main_text(nested).split("\n") == ["Title", *[long.strip()] * 3, "short end"]
    several = f"<article><p>{long}</p><p>{long}</p></article><p>between</p>" + "<article><h2>Note</h2><p>Brief.</p></article>" * 2
    assert html.main_text(several).split("\n") == [long.strip(), long.strip(), *["Note", "Brief."] * 2]


def test_the_seeds_choose_the_region():
    long = "A sentence of the story that goes on and on for a good while, as they do. " * 5
    story = f"<div id='story'><h1>Head</h1><p>{long}</p><p>{long}</p><p>{long}</p></div>"
    card = f"<body><article class='card'><p>See also</p></article>{story}</body>"
    assert html.main_text(card).split("\n") == ["Head", *[long.strip()] * 3]
    teaser = "<article><h3><a href='/x'>Another title</a></h3><p>Brief.</p></article>"
    page = f"<body><article><h1>Head</h1><p>{long}</p><p>{long}</p></article><section><h2>More stories</h2>{teaser * 5}</section></body>"
    assert html.main_text(page).split("\n") == ["Head", *[long.strip()] * 2]
    beside = page.replace("<section><h2>More stories</h2>", "").replace("</section>", "")
    assert html.main_text(beside).split("\n") == ["Head", *[long.strip()] * 2]


def test_smoothing_and_threshold_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        ratios = [rng.choice([rng.uniform(0, 8), rng.uniform(60, 200)]) for _ in range(rng.randint(1, 30))]
        bell = {d: math.exp(-d * d / 2) for d in range(-2, 3)}
        want = []
        for k in range(len(ratios)):
            near = [(bell[d], ratios[k + d]) for d in bell if 0 <= k + d < len(ratios)]
            want.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
        assert html.smoothed(ratios) == pytest.approx(want)
        border = html.threshold(ratios)
        low, high = [r for r in ratios if r < border], [r for r in ratios if r >= border]
        if low and high:  # it rests in the middle of both means
            assert border == pytest.approx((sum(low) / len(low) + sum(high) / len(high)) / 2, rel=1e-6)


def test_deep_pages_take_time_by_their_length():
    deep = "<div>" * 30_000 + "<p>" + "deep text " * 20 + "</p>" + "<p>x</p>" * 3_000 + "</b>" * 30_000
    start = time.perf_counter()
    assert html.main_text(deep).startswith("deep text")
    assert time.perf_counter() - start < 20


def test_pages_of_every_kind(spark):
    pages = spark.createDataFrame(
        [(1, "u", None), (2, None, ""), (None, "u", PAGE), (3, "u", "<p>" * 20000 + "deep"), (3, "u", "<p>a</p></div></b><i>b")],
        "page_id long, url string, html string",
    )
    got = html.extract(pages)
    assert got.count() == 5 and got.where("n_chars <> length(text)").count() == 0
    assert {r.text for r in got.where("page_id in (1, 2)").collect()} == {""}
    assert html.extract(pages.limit(0)).count() == 0


# Chat

@given(st.text(st.sampled_from("<|\\im_startend>é\n")))
def test_escapes_come_back(text):
    assert chat.unescaped(chat.escaped(text)) == text
    assert "<|" not in chat.escaped(text)
    assert chat.unescaped_role(chat.escaped_role(text)) == text


def expected_chat(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        e = out.setdefault(conv, [0, hashlib.sha256(), 0, hashlib.sha256()])
        role, text = role or "", text or ""
        e[0] += 1
        e[1].update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            e[2] += len(text)
            e[3].update(text.encode())
    return {k: (n, a.hexdigest(), c, m.hexdigest()) for k, (n, a, c, m) in out.items()}


@pytest.mark.parametrize("part_chars", [1_000_000, 50])
def test_chat_reads_back(spark, part_chars):
    rows = [
        (1, 0, "system", "be <|im_end|>\n kind"), (1, 1, "user", "hi </s>[INST] ok [/INST]"), (1, 2, "assistant", "  lead and trail \n"),
        (1, 3, "assistant", None), (1, 4, "assistant", "<|im_start|>user\n<\\|x é日本\U0001F600"), (2, None, None, "x"),
        (2, 1, "assistant", "y" * 500), (None, 0, "assistant", "z"), (3, 5, "tool\nrole", "a"), (3, 5, "tool\nrole", "a"),
        (4, 0, "assistant", "<|endoftext|>"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df, part_chars=part_chars)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(made).collect()}
    assert got == expected_chat(rows)
    for r in made.collect():  # masked tokens say just the loss spans
        tokens = chat.tokenizer(chat.TOKENIZER)
        ids = [i for i, m in zip(r.input_ids, r.loss_mask, strict=True) if m]
        assert tokens.decode(ids, skip_special_tokens=False) == "".join(r.text[s.start : s.end] for s in r.loss_spans)
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


# Pieces

@pytest.fixture(scope="module")
def model():
    return pieces.Model(pieces.MODEL)


def test_pieces_equal_the_library(model):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdest  01é世.-\n▁") for _ in range(rng.randint(0, 80))) for _ in range(600)]
    for text in [*texts, "", "a", " ", "a" * 300, "\U0001F600\x00 z"]:
        line = model.normal(text)
        assert model.encode(line) == model.file.encode(text)
        assert model.decode(model.file.encode(text)) == model.file.decode(model.file.encode(text))
        size = rng.choice([17, 20, 33, 40])
        parts = max(1, math.ceil(len(line) / size))
        places = [(line, k * size, min(len(line), (k + 1) * size), k == parts - 1) for k in range(parts)]
        if line:
            states = pieces.borders([model.lattice.matrix(*place) for place in places])
            ids = [i for k, place in enumerate(places) for i in model.chunk(*place, states[k], states[k + 1])]
            assert ids == model.file.encode(text)


def test_unigram_paths_by_brute_force():
    rng = random.Random(3)
    scores = {"".join(p): -rng.random() * 5 for n in (1, 2, 3) for p in itertools.product("ab", repeat=n)}
    lattice = pieces.Lattice(scores, merged=False)
    assert lattice.cuts

    def best(text):
        if not text:
            return 0.0
        return max(scores[text[:n]] + best(text[n:]) for n in (1, 2, 3) if n <= len(text))

    for _ in range(40):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 15)))
        found = lattice.word(text)
        assert "".join(found) == text and sum(scores[p] for p in found) == pytest.approx(best(text))
        size = 6
        parts = math.ceil(len(text) / size)
        places = [(text, k * size, min(len(text), (k + 1) * size), k == parts - 1) for k in range(parts)]
        states = pieces.borders([lattice.matrix(*p) for p in places])
        again = []
        for k, place in enumerate(places):
            head, middle, tail = lattice.chunk(*place, states[k], states[k + 1])
            again += [*head, *([middle] if middle else []), *tail]
        assert "".join(again) == text and sum(scores[p] for p in again) == pytest.approx(best(text))


def test_max_plus_products_are_associative():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(-9, 9, s).astype(float) for s in ((2, 3), (3, 4), (4, 2)))
    left = pieces.product(pieces.product(a, b), c)
    assert (left == pieces.product(a, pieces.product(b, c))).all()
    assert (pieces.prefixes([a, b, c])[-1] == left).all()


@pytest.mark.parametrize("chunk", [65_536, 300])
def test_pieces_of_odd_rows(spark, odd, none, model, chunk):
    got = pieces.digests(odd, chunk=chunk)
    assert got.count() == odd.count() and got.where("not round_trip").count() == 0
    want = sorted(
        hashlib.sha256(",".join(map(str, model.file.encode(r.text or ""))).encode()).hexdigest() for r in odd.collect()
    )
    assert sorted(r.ids_sha256 for r in got.collect()) == want
    coded = pieces.encode(odd, chunk=chunk)
    assert "ids" in coded.columns and len(set(coded.columns)) == len(coded.columns)
    joined = {}
    for r in pieces.decode(coded).where("doc_id in (5, 7)").orderBy("part").collect():
        joined[r.doc_id] = joined.get(r.doc_id, "") + r.text
    assert joined == {r.doc_id: r.text for r in odd.where("doc_id in (5, 7)").collect()}
    assert pieces.digests(none).count() == 0
