import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import html, licenses, packing, quality, tokens
from tests.llm.helpers import documents, frame, words

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_quality_counts_match_brute_force(spark):
    expected = []
    for doc_id, text, *_ in documents():
        text = text or ""
        ws = words(text)
        windows = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        again = {k + j for k in range(len(ws) - 4) if windows[tuple(ws[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if words(x)]
        failed = len(ws) < 10 or 100 * len(again) > 20 * len(ws)
        expected.append((doc_id, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed))
    got = quality.quality(frame(spark)).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter(expected)
    assert not any(r.kept for r in got if r.base_failed)
    assert any(r.kept for r in got)


def test_quality_keeps_columns_and_empty_tables(spark):
    docs = frame(spark)
    assert quality.keep_quality(docs).columns == docs.columns
    assert quality.quality(docs.limit(0)).count() == 0


def test_rules_compile_to_a_verdict(spark):
    rows = [(1, "word " * 3 + "symbols ### " * 20, None, None, None, None, None, None, None)]
    only = (quality.Rule("symbol_ratio", 0, 0.05),)
    assert [r.kept for r in quality.quality(frame(spark, rows), only).collect()] == [False]


def test_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer

    tokenizer, window = Tokenizer.from_file(BYTES), 64
    docs = [r for r in documents() if r[0] is not None]
    docs = list({r[0]: r for r in docs}.values())
    pieces = packing.pack_documents(frame(spark, docs), BYTES, window).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for r in docs:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[r[0]], key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == np.array(ids, "<u4").tobytes()
        assert [p.start for p in own] == list(np.cumsum([0, *[p.length for p in own]])[:-1])
        assert {p.doc_tokens for p in own} == {len(ids)}
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0, *[p.length for p in own]])[:-1])
        assert sum(p.length for p in own) <= window


def test_packing_digests_and_odd_rows(spark):
    got = packing.pack_digests(frame(spark), BYTES).collect()
    assert sum(r.doc_id is None for r in got) == 2
    assert sum(r.doc_id == 3 for r in got) == 3  # one piece, three rows
    empty = [r for r in got if r.doc_tokens == 1]
    assert {r.ids_crc32 for r in empty} == {zlib.crc32(bytes(4))}
    assert packing.pack_digests(frame(spark, []), BYTES).count() == 0


def test_best_fit_decreasing_takes_the_tightest_window():
    lengths = np.sort(np.random.default_rng(1).integers(1, 101, 700))[::-1]
    bins, offsets = packing.best_fit_decreasing(lengths, 100)
    room = []
    for need in lengths.tolist():
        fits = [r for r in room if r >= need]
        if fits:
            room[room.index(min(fits))] -= need
        else:
            room.append(100 - need)
    filled = np.bincount(bins, weights=lengths)
    assert sorted(100 - filled) == sorted(room)
    assert offsets.max() < 100


def test_encoder_equals_whole_text_encoding():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(BYTES), packing.Encoder(BYTES)
    hard = ["a  b", " a", "a ", "x \n y", "<|endoftext|> z<|endoftext|>", "it's we'll", "\t\t a", "", "\0\0\0 \0\0", "a" * 30_000, "^" * 30_000, "漢" * 9_000]
    hard += ["x" + white * n + "y" for white in (" ", "\n", " \t", "\u3000", "\x85") for n in (9_999, 10_000, 1_000_000)]
    for text in [r[1] or "" for r in documents()] + hard:
        assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_equals_the_library_for_every_code_point():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(BYTES), packing.Encoder(BYTES)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "\nq".join(f"a {chr(c)} b{chr(c)}{chr(c)}1{chr(c)} " for c in points[at : at + 4096])
        assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_windows_of_ids_lie_end_to_end():
    import pyarrow as pa

    found = [np.arange(1, n + 1, dtype="<u4").tobytes() for n in (1, 7, 3, 8, 16, 5)]
    for most in (1, 2, 100):
        rows = [r for b in packing._cut(pa.array([4, None, 2, 2, 0, 9]), found, 4, most) for r in b.to_pylist()]
        expected = [(d, at, x[4 * at : 4 * at + 16], len(x) // 4) for d, x in zip([4, None, 2, 2, 0, 9], found, strict=True) for at in range(0, len(x) // 4, 4)]
        assert [(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]) for r in rows] == expected
        assert all(r["length"] * 4 == len(r["ids"]) for r in rows)


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in documents())
    got = tokens.token_counts(frame(spark), PIECES, limit=500).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected
    assert all(r.over_limit == (r.n_tokens > 500) for r in got)
    assert tokens.token_counts(frame(spark, []), PIECES).count() == 0


def test_rank_synchronous_merging_on_hard_texts():
    import random

    import sentencepiece

    library, counter, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), tokens.PieceCounter(PIECES, remember=100), random.Random(2)
    hard = ["a" * 500, "ab" * 300, "     " * 9 + "q", "日本語のテキスト" * 30, "<s> </s>", "\x00\n\t", "▁▁ x ▁", "the" * 200]
    hard += ["".join(rng.choice(["ab", "a", "the", "in", "er", "  ", "é", "\n", "😀"]) for _ in range(rng.randint(1, 120))) for _ in range(300)]
    assert counter.counts(hard) == [len(library.encode(t)) for t in hard]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>text with   spaces&nbsp;here.<br>Next line.<div class="ad">Buy now</div><p>Short.</p>
<ul><li>item one<li>item two</ul><form><input name=q><p>form</p></form><p>Last &lt;tag&gt; &#233;.</p></article>
<aside>side</aside><section id="comments"><article class="comment"><p>A reader's comment that is quite long and talks a lot.</p></article></section><footer>foot"""


def test_html_main_text():
    assert html.main_text(PAGE) == "Title & more First boldtext with spaces here. Next line. Short. item one item two Last <tag> é."
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    unmarked = "<body><div><a href=x>one</a> <a>two</a></div><div>" + "<p>" + "words and words " * 20 + "</p>" * 1 + "<p>End.</p></div><footer>f</footer>"
    assert html.main_text(unmarked) == ("words and words " * 20).strip() + " End."
    assert html.main_text("<p>" + "long " * 50_000).count("long") == 50_000


def test_html_articles_weigh_and_do_not_exclude():
    body = "Words of the body that go on for a while. " * 6
    cards = "<div class='more-stories'>" + "<article class='card'><a href=x>A card</a></article>" * 3 + "</div>"
    page = f"<body><div id=content><p>{body}</p><div class=ad>Buy</div><p>Short one.</p><div class=ad>Buy</div><p>{body}</p></div><div class=ad>x</div>{cards}</body>"
    assert html.main_text(page) == f"{body}Short one. {body}".strip()
    lead = "A lead that stands in front of the article and is long enough to count as text. "
    assert html.main_text(f"<p>{lead}</p><article><p>{body}</p><div class=ad>x</div><p>End</p></article>") == f"{lead}{body}End"


def test_html_extract_rows(spark):
    rows = [(1, "u", PAGE, 9), (1, "u", PAGE, 9), (2, None, None, 9), (None, "v", "", 9)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_licenses(text):
    import re

    norm = re.sub(r"[^\w\n]+|_", " ", text.lower())
    units = [("line", k, x) for k, x in enumerate(norm.split("\n"))]
    units += [("paragraph", k, x) for k, x in enumerate(p for p in re.split(r"\n(?:[ ]?\n)+", norm) if "\n" in p)]
    units += [("text", 0, norm)] * ("\n" in norm)
    for unit, k, x in units:
        ws = x.split()
        grams = {f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)}
        scores = []
        for name, template in licenses.TEMPLATES.items():
            other = set(licenses.template_bigrams(template))
            dice = 2 * len(grams & other) / (len(grams) + len(other))
            if dice >= licenses.THRESHOLD:
                scores.append((-dice, name))
        if scores:
            yield unit, k, min(scores)[1]


def test_license_scan_matches_brute_force(spark):
    t = licenses.TEMPLATES
    texts = [f"some text\n{t['MIT']}\nmore", t["MIT-text"], t["MIT-text"].replace(". ", ".\n"), "a\n\n" + t["Apache-2.0-header"].replace(", ", ",\n") + "\n\nb", t["CC-BY-NC-4.0"].upper(), t["GPL-3.0"].replace("GNU ", ""), "MIT", None, "", "word " * 3000]
    rows = [(k, x, *[None] * 7) for k, x in enumerate(texts)] + [(0, texts[0], *[None] * 7)]
    got = Counter((r.doc_id, r.unit, r.unit_index, r.license) for r in licenses.scan(frame(spark, rows)).collect())
    expected = Counter((r[0], *found) for r in rows if r[1] for found in brute_licenses(r[1]))
    assert got == expected and len(got) >= 5


def test_license_scan_finds_what_is_part_of_a_larger_unit(spark):
    t, other = licenses.TEMPLATES, " ".join(f"w{k} the" for k in range(100)) + " "
    mit = t["MIT-text"].replace("conditions: ", "conditions:\n\n").replace("Software. THE", "Software.\n\nTHE")
    texts = [f"{other}\n\n{mit}\n\n{other}", "Some prose before it ends here now. Released under the MIT License.", "This project is licensed under the MIT License. More.", other]
    texts += [f"{t['MIT']}\nsee {t['CC-BY-NC-4.0']} and so on, as said before", f"{other}{t['GPL-3.0']} {t['Apache-2.0']} {other}"]
    rows = [(k, x, *[None] * 7) for k, x in enumerate(texts)]
    got = Counter((r.doc_id, r.unit, r.license) for r in licenses.scan(frame(spark, rows)).collect())
    expected = [(0, "window", "MIT-text"), (1, "window", "MIT"), (2, "window", "MIT"), (4, "line", "MIT"), (4, "window", "CC-BY-NC-4.0"), (5, "window", "GPL-3.0"), (5, "window", "Apache-2.0")]
    assert got == Counter(expected)


@pytest.mark.parametrize("operator", [licenses.scan, quality.keep_quality])
def test_empty_tables(spark, operator):
    assert operator(frame(spark, [])).count() == 0


def test_license_texts_are_found_in_files(spark):
    t = licenses.TEMPLATES
    code = "\n".join(f"def f{k}(x):\n    return x + {k}" for k in range(60))
    commented = "\n".join("# " + x for x in re.findall(r".{1,70}(?:\s|$)", t["GPL-3.0-header"]))
    texts = [f"Copyright (c) 2020 A. B.\n\n{t[name]}\n" for name in ("BSD-2-Clause-text", "BSD-3-Clause-text", "ISC-text", "Unlicense", "Zlib")]
    texts += [f"{commented}\n\n{code}", f"/* {t['MPL-2.0-header']} */\n{code}", code]
    rows = [(k, x, *[None] * 7) for k, x in enumerate(texts)]
    got = {(r.doc_id, r.license) for r in licenses.scan(frame(spark, rows)).collect()}
    expected = {(0, "BSD-2-Clause-text"), (1, "BSD-3-Clause-text"), (2, "ISC-text"), (3, "Unlicense"), (4, "Zlib"), (5, "GPL-3.0-header"), (6, "MPL-2.0-header")}
    assert expected <= got and not any(k == 7 for k, _ in got)


def test_anchors_are_in_every_match():
    for name, text in licenses.TEMPLATES.items():
        grams = licenses.template_bigrams(text)
        own = set(licenses.all_anchors(licenses.TEMPLATES, licenses.THRESHOLD)[name])
        left = [g for g in grams if not own & set(g.split())]
        assert len(left) < licenses._needed(len(grams), licenses.THRESHOLD)


def test_templates_from_a_folder(spark, tmp_path):
    long = " ".join(f"clause{k % 97} text{k}" for k in range(3000))
    (tmp_path / "House-1.0.txt").write_text(long)
    found = licenses.read_templates(str(tmp_path))
    rows = [(1, long.replace("clause5 ", "clause6 "), *[None] * 7), (2, "clause1 text1", *[None] * 7)]
    assert [(r.doc_id, r.license) for r in licenses.scan(frame(spark, rows), found).collect()] == [(1, "House-1.0")]
