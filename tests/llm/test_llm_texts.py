"""Operators on single texts, pages and conversations: hand-made cases, brute force and exact round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from loomdex.llm import bpe, chat, html, packing  # noqa: E402

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")


# HTML

WEIGHTS = html.learn_weights()
PAGES = [
    (None, ""),
    ("", ""),
    ("<html><body><nav>only a menu</nav></body></html>", ""),
    ("<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>One &amp; two.<p>Three</article><footer>end of it</footer>", "Title One & two. Three"),
    ("<article><p>a</p><aside>side words here</aside><p>b</p></article>", "a b"),
    ("<article>x<script>var a = '</p> words in code';</script> y<style>p{}</style></article>", "x y"),
    ("<main><p>un<b>broken</b> word,&nbsp; next<br>line</p></main>", "unbroken word, next line"),
    ("<div class='cookie-banner'>we use cookies</div><article><p>text</p></article>", "text"),
    ("<article><p>story</p><section id=comments><p>nice story indeed</p></section></article>", "story"),
    ("<article><form><input value=x>send this form</form>kept</article>", "kept"),
    ("<article><header><h1>Head</h1></header><p>body</p><footer>tags and dates</footer></article>", "Head body"),
    ("<!-- <article>no</article> --><article>yes<!-- no --></article>", "yes"),
    ("<article><p>open to the end", "open to the end"),
    ("<article>a < b and c > d</article>", "a < b and c > d"),
    ('<article><p title="a > b">t</p></article>', "t"),
    ("<article><p>&lt;b&gt; &#233; &eacute; &amp</p></article>", "<b> é é &"),
    ("<body><ul><li><a href=1>a</a></li><li><a href=2>b</a></li></ul><p>A long piece of plain text stands here.</p>"
     "<p>And another one.</p></body>", "A long piece of plain text stands here. And another one."),
    ("<article><p class=ad>buy this<p>real</article>", "real"),
    ("<article><div hidden>gone</div><div style='display: none'>gone</div>here</article>", "here"),
    ("</p></div><article>after stray ends</article>", "after stray ends"),
    ("<article><!-- never closed", ""),
    ("<article><script>never closed", ""),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_main_text(page, want):
    assert html.main_text(page, WEIGHTS) == want


BODY = "<p>The first long paragraph of the article stands here.</p><p>And the second one follows it.</p>"
BODY_TEXT = "The first long paragraph of the article stands here. And the second one follows it."
MISLEADING = [
    (f"<!-- <article> --><body>{BODY}</body>", BODY_TEXT),
    (f"<script>var t = '<main >';</script><body>{BODY}</body>", BODY_TEXT),
    (f"<nav><article>menu</article></nav><body>{BODY}</body>", BODY_TEXT),
    (f'<article><p class="skip-intro lead">Lead.</p><h2 class="related-work">Related work</h2>{BODY}</article>', f"Lead. Related work {BODY_TEXT}"),
    (f'<article><div id="signup-flow">{BODY}</div></article>', BODY_TEXT),
    (f'<article>{BODY}<div class="signup-flow">Join us today</div></article>', BODY_TEXT),
    (f'<article>{BODY}<p>Press the <button>Start</button> key and the <label>Name</label> field.</p></article>', f"{BODY_TEXT} Press the Start key and the Name field."),
    (f'<article>{BODY}</article><article class="comment"><p>Nice words, thank you.</p></article>', BODY_TEXT),
    (f'<main>{BODY}<article class="card"><h3>Other story</h3></article><div class="more-stories"><p>One more</p></div></main>', BODY_TEXT),
    (f'<article class="card">{BODY}</article>', BODY_TEXT),
    (f'<article>{BODY}<div class="share-buttons">Share it</div><div class="comment-list">First!</div></article>', BODY_TEXT),
    (f'<article><div class="teaser">unclosed {BODY}', f"unclosed {BODY_TEXT}"),
]


@pytest.mark.parametrize("page,want", MISLEADING)
def test_misleading_pages(page, want):
    assert html.main_text(page, WEIGHTS) == want


LINKS = "".join(f"<li><a href=/{i}>reference number {i}</a></li>" for i in range(40))
LINKED = " ".join(f"reference number {i}" for i in range(40))
LINKED_PAGES = [
    ("<article><h1><a href=/p>Headline</a></h1><p>text</p></article>", "Headline text"),
    ("<article><p>A long piece of news. Source: <a href=/r>Reuters</a></p></article>", "A long piece of news. Source: Reuters"),
    (f"<nav>menu</nav><article><p>words</p><ol>{LINKS}</ol></article><div>outside it</div>", f"words {LINKED}"),
    (f"<div>before it</div><main><p>one</p><ul>{LINKS}</ul><p>two</p></main>", f"one {LINKED} two"),
    (f"<article><ul>{LINKS}</ul></article>", LINKED),
    (f"<body><main><article><p>one</p></article><ul>{LINKS}</ul><article><p>two", f"one {LINKED} two"),
    ("<div><a href=/1>menu</a></div><p>A long piece of plain text stands here. Source: <a href=/r>Reuters</a></p><div><a href=/2>more</a></div>",
     "A long piece of plain text stands here. Source: Reuters"),
]


@pytest.mark.parametrize("page,want", LINKED_PAGES)
def test_links_at_the_edges_stay(page, want):
    assert html.main_text(page, WEIGHTS) == want


NAMED_PAGES = [
    ('<article><p title="the hidden door">a</p><p>see <a href="/wiki/Hidden_Valley">the valley</a></p></article>', "a see the valley"),
    ('<article><p data-id="share-3">a</p><p><a href="/p?id=reply-1">b</a></p><div data-role=menu>c</div></article>', "a b c"),
    ("<article><p title=\"class='ad' id=menu style='display:none'\">a</p><img alt=hidden><b data-hidden>b</b></article>", "a b"),
    ('<article><p>a</p><h2 id="related-work">Related work</h2><p>b</p><h2 id="social-effects">Social effects</h2>'
     '<h3 id="skip-lists">Skip lists</h3><p id="notice-of-meeting">Notice of meeting</p></article>',
     "a Related work b Social effects Skip lists Notice of meeting"),
    ('<article><h2><span id="Social_effects">Social effects</span></h2><ol><li id="cite-social-1">note</li></ol></article>', "Social effects note"),
    ('<article><p>a</p><section id="related-work"><h2>Related work</h2><p>b</p></section></article>', "a Related work b"),
    ('<article><p>a</p><section id="related-posts"><h2>Read on</h2>x</section><div id=comments><h2>Comments</h2>x</div></article>', "a"),
    ("<article>a<div HIDDEN>x</div><div hidden=''>x</div><div hidden=until-found> b</div><div aria-hidden = true>x</div></article>", "a b"),
    ("<article>a<div id=share class='x'>x</div><div class='x' id=\"share\">x</div><div class=x\nrole='menu'>x</div></article>", "a"),
]


@pytest.mark.parametrize("page,want", NAMED_PAGES)
def test_names_and_ids_of_text_do_not_drop_it(page, want):
    assert html.main_text(page, WEIGHTS) == want


def test_best_region_is_the_best_of_all():
    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.choice([-3.0, -1.0, 0.0, 1.0, 2.5]) for _ in range(rng.randrange(12))]
        a, b = html.best_region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores) + 1) for j in range(i, len(scores) + 1)), default=0)
        assert sum(scores[a:b]) == max(0, best)


def test_weights_sign_and_long_page():
    assert all(v < 0 for k, v in WEIGHTS.items() if not k.startswith("word@"))
    assert WEIGHTS["word@article"] > 0 > WEIGHTS["word@outside"]
    text = " ".join(f"<p>word{i} of a page" for i in range(30_000))
    assert len(html.main_text(f"<article>{text}</article>", WEIGHTS).split()) == 120_000


def test_extract_keeps_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "<article>x</article>", 5), (2, None, 6), (2, None, 6)], "page_id long, html string, main_text int")
    got = {(r.page_id, r.main_text, r.body) for r in html.extract(rows, "html", into="body").collect()}
    assert got == {(1, 5, "x"), (2, 6, "")}
    assert html.extract(rows.where("false"), "html").count() == 0


# Chat


def strip_thoughts(turns):
    """A template that drops what earlier assistant turns thought, and so rewrites history."""
    last = len(turns) - 1
    return "".join(f"<{r}>{t if i == last or r != 'assistant' else t.split('|')[-1]}</>" for i, (r, t) in enumerate(turns))


TURNS = [("system", "be [kind]"), ("user", "</s>[INST] ok [/INST]"), ("assistant", "a\\b\n<s>"), ("user", ""), ("assistant", "0101")]


def test_trace_finds_texts():
    template = chat.TurnTemplate()
    out, spans, rewritten = chat.trace(template, TURNS)
    assert rewritten is None
    assert [template.unescape(out[s:e]) for _, s, e in spans] == [t for _, t in TURNS]
    assert template.read(out) == TURNS
    for control in ("<s>", "</s>", "[INST]"):
        assert not any(control in template.escape(t) for _, t in TURNS)


def test_trace_of_templates_with_headers():
    plain = lambda turns: "BEGIN" + "".join(f"\n### {r}: {t}\n" for r, t in turns)
    out, spans, rewritten = chat.trace(plain, TURNS)
    assert rewritten is None and [out[s:e] for _, s, e in spans] == [t for _, t in TURNS]


def test_rewritten_history_is_found():
    turns = [("user", "q"), ("assistant", "think|yes"), ("user", "more"), ("assistant", "think|no")]
    out, spans, rewritten = chat.trace(strip_thoughts, turns)
    assert rewritten == 2 and out == "<user>q</><assistant>yes</><user>more</><assistant>think|no</>"
    assert out[slice(*spans[3][1:])] == "think|no" and out[slice(*spans[0][1:])] == "q"


def test_read_rejects_broken_text():
    with pytest.raises(ValueError):
        chat.TurnTemplate().read("<s>[user]\nhi</s>\nrest")


def test_conversations_round_trip(spark):
    rng = random.Random(5)
    signs = ["<s>", "</s>", "[INST]", "\\", "\n", "é", "word ", "\\l", ""]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "".join(rng.choices(signs, k=rng.randrange(6)))]))
            for c in [*range(20), None] for t in range(rng.randrange(1, 6))]
    rows += rows[:5]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    template = chat.TurnTemplate()
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(table, template), template).collect()}
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t, r or "", x or ""))
    assert got.keys() == want.keys()
    for c, own in want.items():
        own = [(r, x) for _, r, x in sorted(own)]
        assert [tuple(t) for t in got[c].turns] == own
        assert got[c].loss_text == "".join(x for r, x in own if r == "assistant")
    assert chat.format_conversations(table.where("false"), template).count() == 0


# Byte-level BPE

ODD_TEXTS = ["", "a", " ", "  a  b ", "don't  stop\n\n\nnow", "é́ 漢字 🙂", "x" * 300, "\x1c\x1d a", "1234567 89", "　 z", "a\r\n b"]


def test_pieces_never_cut_a_match():
    import regex

    rng = random.Random(1)
    signs = ["a", "bc", " ", "\n", "\t", "'s", "1", ".", "é", "　", "   "]
    pattern = regex.compile(PATTERN)
    for _ in range(300):
        text = "".join(rng.choices(signs, k=rng.randrange(80)))
        whole = pattern.findall(text)
        pieces = list(bpe.safe_pieces(text, size=7, run=4))
        assert "".join(p for _, p in pieces) == text
        assert [m for one, p in pieces for m in ([p] if one else pattern.findall(p))] == whole


def test_long_blank_runs_encode_as_the_library_does():
    encoding = bpe.load_encoding(RANKS, PATTERN)
    for text in (*ODD_TEXTS, "a" + " " * 50_000 + "b", " " * 20_000, "w " * 100_000, "ab" * 70_000):
        ids = bpe.encode_text(encoding, text)
        assert ids == encoding.encode_ordinary(text)
        assert encoding.decode_bytes(ids) == text.encode()
    huge = "x" + " " * 1_000_000 + "y"  # more than the library can match
    assert encoding.decode_bytes(bpe.encode_text(encoding, huge)) == huge.encode()


def test_encode_decode_table(spark):
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate([*ODD_TEXTS, None, None])], "doc_id long, text string, decoded long")
    both = bpe.decode(bpe.encode(rows, "text", RANKS, PATTERN), "token_ids", RANKS, PATTERN, into="raw")
    encoding = bpe.load_encoding(RANKS, PATTERN)
    for r in both.collect():
        assert bytes(r.raw) == (r.text or "").encode() and r.token_ids == encoding.encode_ordinary(r.text or "")
        assert r.decoded == r.doc_id
    assert bpe.encode(rows.where("false"), "text", RANKS, PATTERN).count() == 0


# Packing


def test_word_encoder_equals_the_library():
    encoder = packing.WordEncoder(WORDS)
    texts = [*ODD_TEXTS, "İstanbul, İ", "The's A's. it.'s 'tis", "a_b c__ _", "ΣΑΣ Σ.", "１２ ４", "<|endoftext|> x", "É é é.", "the of, and!! x###", None]
    for some in (texts, [t for t in texts if t is None or "\x1c" not in t]):
        got = encoder.encode(pa.array(some, pa.string()), 1).to_pylist()
        want = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in some]
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_windows_hold_every_id_once_and_are_full():
    rng = random.Random(2)
    for _ in range(30):
        lengths = [rng.choice([1, 5, 100, 255, 256, 257, 1024, 2048, 2049, 9000, rng.randrange(1, 4000)]) for _ in range(rng.randrange(60))]
        windows = packing.pack_block(lengths)
        spans = {d: [] for d in range(len(lengths))}
        for w in windows:
            for d, s, n in w:
                spans[d].append((s, n))
        for d, n in enumerate(lengths):
            at = 0
            for s, k in sorted(spans[d]):
                assert s == at and k > 0
                at += k
            assert at == n
        sizes = [sum(n for *_, n in w) for w in windows]
        assert sum(x != 2048 for x in sizes) <= 1 and all(x <= 2048 for x in sizes)
        steps = packing.steps_of(windows, 4)
        counts = [steps.count(s) for s in range(max(steps, default=-1) + 1)]
        assert not counts or (max(counts) <= 4 and max(counts) - min(counts) <= 1)


def test_pack_table(spark):
    texts = ["", None, "one two three", "word " * 5000, "same text", "same text"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x")], "doc_id long, text string, ids string")
    got = packing.pack(rows, "doc_id", "text", WORDS, 1, block_tokens=3000).collect()
    encoder = packing.WordEncoder(WORDS)
    for i, t in [*enumerate(texts), (None, "no id")]:
        whole = encoder.encode(pa.array([t], pa.string()), 1)[0].as_py()
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == whole and {r.doc_tokens for r in own} == {len(whole) // 4}
        assert all(zlib.crc32(r.ids) == zlib.crc32(whole[4 * r.start : 4 * (r.start + r.length)]) for r in own)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(rows.where("false"), "doc_id", "text", WORDS, 1).count() == 0


SPECIAL = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>y z", "<|EndOfText|> up", "plain words", None, "", "a\x1cb <|endoftext|>", "<|endoftext|><|endoftext|>"]


def test_special_tokens_as_the_library_has_them():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    got = packing.WordEncoder(WORDS).encode(pa.array(SPECIAL, pa.string()), 1)
    for text, ids in zip(SPECIAL, got.to_pylist()):
        assert np.frombuffer(ids, "<u4").tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 1]
    assert np.frombuffer(got[0].as_py(), "<u4").tolist() == [320, 49407, 321, 1]
    library.encode_special_tokens = True
    plain = packing.WordEncoder(WORDS, plain_specials=True).encode(pa.array(SPECIAL, pa.string()), 1)
    for text, ids in zip(SPECIAL, plain.to_pylist()):
        assert np.frombuffer(ids, "<u4").tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 1]
