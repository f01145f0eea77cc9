"""Toxicity on held-out labels, text extraction on small pages, and the pipeline against a plain version."""

import re
import zlib

import public_tokenizers

import brute
import corpus_pipeline
import pytest

from compare import DATA, duck, rows_of, rows_of_sql
from odd_rows import ODD, SF, pairs, table
from ridgeline.llm import decontaminate, html, pii, quality, toxicity


def test_quality_equals_sql(spark):
    assert rows_of(quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).drop("fp")) == rows_of_sql(duck(SF), quality.ORACLE)


def test_toxicity_on_held_out_labels(spark):
    d = str(DATA / "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    toxic, clean = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean)) > 0.85


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (6, 0), (9, 0), (11, 1), (None, 1), (5, None)], "doc_id bigint, toxic int")
    for train_on in (odd, none):
        scores = toxicity.score(odd, toxicity.train(train_on, labels)).collect()
        assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
        assert len({r.score for r in scores if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(none, toxicity.train(odd, labels)).count() == 0


def test_toxicity_by_the_whole_model(spark, monkeypatch):
    """Contexts that are not broadcast are joined, so scores do not depend on what is broadcast."""
    d = str(DATA / "sf0.001")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    expected = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    for grams in (2000, 0):
        monkeypatch.setattr(toxicity, "GRAMS", grams)
        got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_toxicity_counts_folds_0_and_2_alone(spark):
    fold = {k: [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == k] for k in range(3)}
    said = {0: "grumbleword", 1: "heldoutword", 2: "snarlword"}
    rows = [(i, f"plain words of the text {i}" + (f" {said[k]}" if n % 3 == 0 else "")) for k in fold for n, i in enumerate(fold[k])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(n % 3 == 0)) for k in fold for n, i in enumerate(fold[k])], "doc_id bigint, toxic int")
    judge = toxicity.Judge(toxicity.train(docs, labels).local)
    x = dict(zip(said, judge.of_words([w.encode() for w in said.values()]).tolist(), strict=True))
    assert x[0] > 3 and x[2] > 3 and x[1] < min(x[0], x[2]) / 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav>
<header class="top">Site name</header><article><h1>A headline for the article</h1><p>First paragraph, with <b>bold</b> words &amp; a reference. It has two sentences.<script>var x = "</p>";</script>
<p>Second   paragraph
of the article, which is also long enough to be read.</p></article><div class="ad">Buy this now</div><div class="comments"><p>I do not agree with this at all, said a reader.</p></div><footer>&copy; 2024 All rights reserved</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, "v", None), (None, None, ""), (4, "w", "just <b>text</b>, which stands for itself and has no markup to speak of."), (5, "x", "<p" * 3000 + "<div>" * 3000), (1, "u", PAGE)]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id bigint, url string, html string, n_chars int, text string")
    got = {(r.page_id, r.url): r for r in html.extract(df).collect()}
    assert got[1, "u"].text == "A headline for the article\nFirst paragraph, with bold words & a reference. It has two sentences.\nSecond paragraph of the article, which is also long enough to be read."
    assert got[2, "v"].text == "" == got[None, None].text and got[2, "v"].n_chars == 0
    assert got[4, "w"].text.startswith("just text, which") and all(r.n_chars == len(r.text) for r in got.values())
    assert html.extract(df).count() == len(rows) and html.extract(df.limit(0)).count() == 0


def test_long_attributes_and_formulas():
    body = "<p>A first sentence of the article, which is long enough to be read. It has two sentences.</p>"
    for quote in "\"'":
        value = quote + "data:image/png;base64," + "Zx<9>" * 20_000 + quote
        page = f"<article>{body}<p><img src={value} alt=x>A second paragraph, also long enough to be read.</p><div class=\"sidebar\" data-x={value}>Buy this now</div></article>"
        assert html.main_text(page) == "A first sentence of the article, which is long enough to be read. It has two sentences.\nA second paragraph, also long enough to be read."
    assert html.main_text(f"<article>{body}<p title=it's>So a quote's end is not needed here, it is plain text.</p></article>").endswith("\nSo a quote's end is not needed here, it is plain text.")
    assert html.main_text(f'<article>{body}<p title="open>It ends at the bracket, and this text stays.</p></article>').endswith("\nIt ends at the bracket, and this text stays.")
    formula = "<math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></math>"
    assert "We find that x=2 holds here, as said." in html.main_text(f"<article>{body}<p>We find that {formula} holds here, as said.</p></article>")


#: Blocks of made pages, as (markup around {}, is content); long texts are sentences of 30 words.
PARTS = [
    ("<h1 class='post-header'>{short}</h1>", True), ("<p>{long}</p>", True), ("<p>{long}</p>", True), ("<div class='article-tags social-story'><p>{long}</p><p>{long}</p></div>", True), ("<blockquote>{long}</blockquote>", True),
    ("<div class='ad'>{short}</div>", False), ("<aside>{long}</aside>", False), ("<ul class='related'><li><a href=x>{short}</a></li><li><a href=y>{short}</a></li></ul>", False),
]
OUTSIDE = [("<nav><a href=/>{short}</a></nav>", 0), ("<header>{short}</header>", 0), ("<div class='cookie-notice'>{long}</div>", 0), ("<div id='comments'><p>{long}</p><p>{long}</p></div>", 1), ("<form><p>{short}</p></form>", 1), ("<footer>{short} &copy; 2024</footer>", 1), ("<div class='sidebar'>{short}</div>", 1)]


def made_pages(n: int, rng) -> list[tuple[str, set, set]]:
    """(html, texts of content, other texts)."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9)))
    out = []
    for k in range(n):
        good, bad = set(), set()

        def filled(markup: str, content: bool, good=good, bad=bad) -> str:
            for kind, size in (("{short}", 4), ("{long}", 30)):
                while kind in markup:
                    text = " ".join(word() for _ in range(size)).capitalize() + ("." if size > 4 else "")
                    text = text.replace(" ", ", ", 1) if size > 4 else text
                    (good if content else bad).add(text)
                    markup = markup.replace(kind, text, 1)
            return markup

        body = "".join(filled(m, c) for m, c in PARTS if c or rng.random() < 0.5)
        before = "".join(filled(m, False) for m, at in OUTSIDE if at == 0 and rng.random() < 0.7)
        after = "".join(filled(m, False) for m, at in OUTSIDE if at == 1 and rng.random() < 0.7)
        tag = ("article", "main", "div class='content'")[k % 3]
        out.append((f"<html><body>{before}<{tag}>{body}</{tag.split()[0]}>{after}</body></html>", good, bad))
    return out


def test_made_pages(spark):
    """Precision and recall by blocks, with weights fitted to the pages."""
    import random

    pages = made_pages(60, random.Random(4))
    df = spark.createDataFrame([(i, "u", h) for i, (h, _, _) in enumerate(pages)], "page_id bigint, url string, html string")
    weights = html.train(df)
    right = wrong = missed = 0
    for r in html.extract(df, weights).collect():
        got, (_, good, bad) = set(r.text.split("\n")), pages[r.page_id]
        right, wrong, missed = right + len(got & good), wrong + len(got & bad), missed + len(good - got)
        assert got <= good | bad
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97, (right, wrong, missed)


def test_one_class_word_deletes_no_article():
    long = "A sentence of the article, which is long enough to be read and says something to whoever reads it. "
    page = f"<article><h1 class='post-header'>Title</h1><p>{long}</p></article>"
    assert html.main_text(page).startswith("Title\nA sentence")
    assert html.main_text(f"<article><div class='article-tags social-story'><p>{long}</p><p>{long * 2}</p></div></article>").count("A sentence") == 3


LONG = "A first sentence of the article, which is long enough to be read. It has two sentences."
BODY = f"<p>{LONG}</p><p>A second paragraph, also long enough to be read, said the man.</p>"
READ = f"{LONG}\nA second paragraph, also long enough to be read, said the man."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>TITLE</title><body><article>{BODY}</article>", f"<title>TITLE</title><article>{BODY}</article>", f"<article><div class='content ad'>{BODY}</div></article>", f"<article><div class='popup story'>{BODY}</div></article>",
        f"<article><div class='modal-story'>{BODY}</div></article>", f"<article>{BODY}<p hidden>Some hidden text that nobody should see, ever, at all.</p></article>", f"<article>{BODY}<div aria-hidden=true><p>{LONG}</p></div><p style='display: none'>{LONG}</p></article>",
        f"<article>{BODY}</article><section class='discussion'><p>I do not agree with this at all, said a reader.</p><p>Nor do I, as I said before, in the other thread.</p></section>", f"<article>{BODY}</article><!-- never ends <p>{LONG}</p>",
        f"</div></section><article>{BODY}</article></main></b>",
    ],
)
def test_odd_pages(page):
    assert html.main_text(page) == READ


@pytest.mark.parametrize("piece", ["<![CDATA[ x ", "<div>", "</section>", "<div>a", "<! ", "<!-- ", '<a ="', "<", "</a ", "<p>a b c. d", "<title>", "<head>", "<td>x"])
def test_long_pages_take_linear_time(piece):
    import time

    page = piece * (200_000 // len(piece))
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 3  # a second on a machine that is not busy


def test_a_cut_keeps_what_stands_between():
    """A short line speaks for itself as template; between paragraphs it stays, beside links it goes."""
    short = "<div>He left</div>"
    blocks = html.blocks_of(short)
    assert html.evidence(*blocks[0][:3], list(html.PRIOR.values())) < 0 and html.main_text(short) == ""
    assert html.main_text(f"<div><div>{LONG}</div>{short}<div>{LONG}</div></div>") == f"{LONG}\nHe left\n{LONG}"
    links = "<div><a href=x>More of this</a></div>"
    assert "He left" not in html.main_text(f"<div>{links}{short}{links}</div><article>{BODY}</article>")


def test_labels_come_from_repetition(spark):
    """Template is what stands on different pages of one host, under whatever names; copies of a page count once."""
    rng = __import__("random").Random(1)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize() + ", so."
    box = text(30)
    pages = [f"<div class='zig'><p>{box}</p></div><div class='zag'>" + "".join(f"<p>{text(20)}</p>" for _ in range(4)) + "</div>" for _ in range(40)]
    pages += [pages[0]] * 40
    df = spark.createDataFrame([(i, f"https://a.example.com/{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    weights = dict(zip(html.NAMES, html.train(df), strict=True))
    assert weights != html.PRIOR
    alike = df.where("page_id >= 40")  # one text alone: nothing to tell template by
    assert html.train(alike) == list(html.PRIOR.values())


def test_weights_without_pages(spark):
    none = spark.createDataFrame([(1, "u", None), (2, "v", "")], "page_id bigint, url string, html string")
    assert html.train(none) == html.train(none.limit(0)) == list(html.PRIOR.values())


def test_minimum_cut_is_least():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(1, 8)
        a, b = [rng.randrange(6) for _ in range(n)], [rng.randrange(6) for _ in range(n)]
        edges = [(i, j, rng.randrange(1, 5)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda side: sum(b[i] if side[i] else a[i] for i in range(n)) + sum(w for i, j, w in edges if side[i] != side[j])  # noqa: E731, B023
        assert abs(cost(html.minimum_cut(a, b, edges)) - min(map(cost, itertools.product((False, True), repeat=n)))) < 1e-6


def test_pipeline(spark):
    """Every stage again in plain Python, each on what the one before kept."""
    got = corpus_pipeline.run(spark, SF)
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {x[0] for x in brute.kept_by_rules(docs) if x[-1]}
    rows = [(i, t) for (i, _, _), t in zip(docs, brute.texts_by_rules(docs), strict=True) if i in kept]
    first = {i for i, _, c in brute.jaccard_components(rows, 80, 5) if i == c}
    rows = [(i, t) for i, t in rows if i in first]
    word, windows, out = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), set(), []
    fold = lambda t: [w.translate(brute.LOWER) for w in word.findall(t)]
    for _, text in items:
        w = fold(text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    for i, text in rows:
        w, hit = fold(text), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if hit and len(hit) == len(w):
            continue
        spans = decontaminate.merged([(k, k + 1) for k in hit])
        out.append((i, pii.masked(decontaminate.cut(text, spans))))
    expected = brute.byte_pairs(out, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert table(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "personal data", "tokens"]
    assert len(pairs(spark.read.parquet(f"{SF}/documents.parquet"))) > len(out) > 0


def test_pipeline_on_odd_and_empty_rows(spark, odd):
    """Nulls, empty texts, repeated rows and special tokens go through all stages; no rows give none."""
    rows = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for docs, some in ((rows, True), (rows.limit(0), False)):
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.materialise(stage(spark, docs, SF), "odd-stage")
            assert name == "tokens" or out.columns == docs.columns
            docs = out
        got = docs.collect()
        assert bool(got) == some and {r.doc_id for r in got} <= {r.doc_id for r in rows.collect()}
        assert all(len(r.ids) == r.n_tokens for r in got)
