"""Tokens, token files, classifiers, chats, pages, rules and decontamination against libraries, brute force and hand-made cases."""

import hashlib
import html
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewave.llm import bpe, chat, decontamination, html_text, quality_model, quality_rules, queries, token_files, toxicity

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "\n\n  x", "it's we'LL don't 've", "a" * 5000, "naïve Zoë 漢字 🙂🙂  　 x", "<|endoftext|> and <|endoftext|>x", "1234567 ١٢ ²", "tab\tand  two   spaces\r\n end ", "\x00\x01", "é ﬁ", "same text", "same text", "!!!???...---", "word " * 3000]


def docs_of(spark, texts, extra=False):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({"ids": F.lit(1), "n_tokens": F.lit("x"), "words": F.lit(2), "seed": F.lit(0), "score": F.lit("y"), "lang": F.lit("en"), "item": F.lit(3)}) if extra else df


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark):
    lib = library()
    texts = TEXTS + [r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    got = {r.doc_id: r for r in bpe.encode_documents(docs_of(spark, texts, True), PATH, with_ids=True).collect()}
    for k, text in enumerate(texts):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids, text
        assert got[k].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(docs_of(spark, []), PATH).count() == 0


def test_decoding_gives_the_texts_back(spark):
    encoded = bpe.encode_documents(docs_of(spark, TEXTS), PATH, with_ids=True)
    assert {r.doc_id: r.text for r in bpe.decode_documents(encoded, PATH).collect()} == {k: t or "" for k, t in enumerate(TEXTS)}


def test_token_files_round_trip(spark):
    lib = library()
    got = sorted(token_files.token_files(docs_of(spark, TEXTS, True).repartition(5), PATH).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, text in zip(got, TEXTS, strict=True):
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.token_files(docs_of(spark, []), PATH).count() == 0


def test_blocks_decode_alone_and_damage_is_seen():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 50_000, 40_000), np.zeros(20_000), [7]]).astype(np.uint32)
    record = token_files.pack(np.array([4]), np.array([False]), np.array([len(ids)]), ids)
    assert (token_files.unpack(record)[3] == ids).all()
    assert (token_files.unpack(record, [1])[3] == ids[token_files.BLOCK : 2 * token_files.BLOCK]).all()
    broken = bytearray(record)
    broken[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.unpack(bytes(broken))


def accuracy(spark, scores, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    rows = scores.where("held_out").join(labels.where(F.col(label).isNotNull()), "doc_id").collect()
    y, p = np.array([r[label] for r in rows]), np.array([r.score for r in rows])
    assert ((p >= 0) & (p <= 1)).all() and all(r.predicted == (r.score >= 0.5) for r in rows)
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    n1 = int(y.sum())
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)), ((p >= 0.5) == y).mean()


@pytest.mark.parametrize(("name", "label", "folds", "held"), [("op3_quality", "quality", 3, 1), ("op5_toxicity", "toxic", 5, 0)])
def test_held_out_accuracy_and_no_leak(spark, name, label, folds, held):
    scores = queries.queries()[name](spark, SF)
    area, right = accuracy(spark, scores, label)
    assert area > 0.9 and right > 0.85, (area, right)
    run = quality_model.quality_scores if label == "quality" else toxicity.toxicity_scores
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds) == held
    turned = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
    some = sorted((r.doc_id, r.score) for r in scores.limit(200).collect())
    again = {r.doc_id: r.score for r in run(docs, turned, label, folds, held).collect()}
    assert all(again[d] == s for d, s in some)


@pytest.mark.parametrize("run", [quality_model.quality_scores, toxicity.toxicity_scores])
def test_classifiers_without_labels_or_texts(spark, run):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    label = "quality" if run is quality_model.quality_scores else "toxic"
    got = run(docs_of(spark, TEXTS, True), labels, label, 3, 1).collect()
    assert len(got) == len(TEXTS) and {r.score for r in got} == {0.5}
    assert run(docs_of(spark, []), labels, label, 3, 1).count() == 0


def test_swapping_identity_terms_hardly_changes_a_score(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    terms = [row[:2] for row in toxicity.IDENTITIES if len(row) > 1]
    texts = [f"a letter about the {t} next door and the garden" for pair in terms for t in pair]
    rows = docs_of(spark, texts).withColumn("doc_id", -1 - F.col("doc_id")).select("doc_id", "text")
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs.select("doc_id", "text").unionByName(rows), labels).where("doc_id < 0").collect()}
    assert len(got) == len(texts)
    assert max(abs(got[-1 - 2 * k] - got[-2 - 2 * k]) for k in range(len(terms))) < 0.1


def test_chat_events_fold(spark):
    events = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "delta", "assistant", "Hel"), (1, 3, 2, "delta", None, "lo"), (1, 4, 2, "regenerate", None, None),
        (1, 5, 2, "delta", None, "Good "), (1, 6, 2, "delta", None, "day"), (1, 7, 1, "edit", None, "hello"), (2, 1, 1, "message", "user", None), (3, 9, 1, "delta", "assistant", chat.HARD),
    ]
    df = spark.createDataFrame(events, chat.EVENT_SCHEMA)
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.fold(df).collect())
    assert got == [(1, 1, "user", "hello"), (1, 2, "assistant", "Good day"), (2, 1, "user", ""), (3, 1, "assistant", chat.HARD)]
    text = {r.conv_id: r.formatted for r in chat.render(chat.fold(df)).collect()}
    assert text[1] == "<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\nGood day<|im_end|>\n" and "[INST]" not in text[3]
    digest = {r.conv_id: r for r in chat.digests(chat.render(chat.fold(df))).collect()}
    assert digest[3].loss_sha256 == hashlib.sha256(chat.HARD.encode()).hexdigest() and digest[1].loss_chars == 8
    assert chat.fold(df.where("false")).count() == 0


def test_chats_with_ties_repeats_and_long_texts(spark):
    """Rows of one turn number follow each other by role and text, repeated rows too; other columns don't matter."""
    long = "long [text] <|im_end|> &amp; " * 40_000
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", long), (1, 1, None, "x"), (2, 0, "assistant", None), (None, 0, "user", "lost"), (3, None, "assistant", ""), (4, 0, "a&<[\nb", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({c: F.lit("clash") for c in ("seq", "kind", "since", "parts", "head", "body", "piece", "start", "pieces", "turns")})
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    for log in (chat.events_of_rows(df), chat.streamed(chat.events_of_rows(df))):
        got = {r.conv_id: r for r in chat.digests(chat.render(chat.fold(log))).collect()}
        assert set(got) == set(by)
        for k, turns in by.items():
            turns.sort()
            whole, loss = "".join(f"{r}\n{t}\n" for _, r, t in turns), "".join(t for _, r, t in turns if r == "assistant")
            assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    by = {-7: [(0, "user", chat.HARD), (1, "assistant", chat.HARD)]}
    for r in rows:
        by.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in queries.op7_chat(spark, SMALL).collect()}
    assert set(got) == set(by)
    for k, turns in by.items():
        turns.sort()
        whole, loss = "".join(f"{r}\n{t}\n" for _, r, t in turns), "".join(t for _, r, t in turns if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_pages(spark):
    menu = "<nav><a href='/'>Home</a></nav><header><p>Site</p></header>"
    foot = "<div class='comments'><p>First!</p></div><footer>&copy; us</footer><script>var a='<p>no</p>';</script>"
    pages = [(k, f"http://h.example/{k}", f"<html><head><title>t</title><style>p{{}}</style></head><body>{menu}<article><h1>Head {k}</h1><p>Fish &amp; chips\n  number {k}.</p></article><div class='ad'>Buy</div>{foot}</body></html>") for k in range(12)]
    pages += [(90, "http://x.example/", None), (91, None, ""), (92, "http://x.example/a", "<p>open <b>bold<p>next &#233;"), (93, "http://x.example/b", "<article><p>" + "long " * 30_000 + "</p></article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"text": F.lit(1), "host": F.lit(2), "node": F.lit(3)})
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    assert len(got) == len(pages)
    assert all(got[k].text == f"Head {k} Fish & chips number {k}." for k in range(12))
    assert (got[90].text, got[91].text, got[92].text) == ("", "", "open bold next é")
    assert got[93].n_chars == len(("long " * 30_000).strip())
    assert html_text.main_text(df.where("false")).count() == 0


def texts_of(spark, pages):
    df = spark.createDataFrame([(k, url, page) for k, (url, page) in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.main_text(df).collect()}


@pytest.mark.parametrize("name", "comment-list comments-area user-comments post-comments site-footer site-header sidebar-left sidebar__inner menu-items main-menu top-nav nav-links ad-slot ad-container advertisement-box cookie-bar cookieConsent gdpr newsletter-form related-posts promo-box share-buttons widget-area".split())
def test_usual_names_on_a_host_of_one_page(name):
    prose = " ".join(["Text of the article that is long enough."] * 6)
    for page in (f"<body><article><p>{prose}</p><div class='{name}'><p>beside it</p></div></article></body>", f"<body><div class='{name}'>beside it</div><article><p>{prose}</p></article><section id=\"{name}\"><p>more</p></section></body>"):
        blocks, _ = html_text.parse(page)
        assert [b.text for b in blocks if not b.cut] == [prose]


def test_names_that_are_text_and_text_that_is_hidden():
    prose = " ".join(["Text of the article that is long enough."] * 6)
    shown = lambda page: [b.text for b in html_text.parse(page)[0] if not b.cut]
    assert shown(f"<article><p>{prose}</p><p class='legal'>A law.</p><section class='social'><h2>Society</h2><p>People.</p></section><div class='post-header'>Lead.</div></article>") == [prose, "A law.", "Society", "People.", "Lead."]
    assert shown(f"<body class='has-sidebar'><div class='with-sidebar'><p>{prose}</p></div><div style='color: red; display: none'>gone</div><p hidden>gone</p><div data-hidden='x'>stays</div></body>") == [prose, "stays"]
    comments = "<ol class='comment-list'><li><article class='comment-body'><p>A reader's opinion.</p></article></li></ol>"
    assert shown(f"<body><article><p>{prose}</p></article>{comments}</body>") == [prose]


def test_style_tree_cuts_what_stands_in_every_article_of_a_host(spark):
    page = lambda k: f"<article><h1>Head {k}</h1><p>This is told only on page {k} of the host.</p><p>Read us daily.</p></article><p>Outside {k}</p>"
    got = texts_of(spark, [(f"http://many.example/{k}", page(k)) for k in range(12)] + [("http://few.example/", page(50))])
    assert all("Read us" not in got[k] and f"Head {k} This is told only on page {k} of the host." in got[k] for k in range(12))
    assert "Read us daily." in got[12]
    # pages that differ in a line only are copies: what they share is their text
    same = "".join(f"<p>Paragraph {j} of one long story.</p>" for j in range(9))
    got = texts_of(spark, [(f"http://copy.example/{k}", f"<article>{same}<p>Seen {k}</p></article>") for k in range(12)])
    assert all("Paragraph 8 of one long story." in t for t in got.values())


def test_mirrored_pages_keep_their_text(spark):
    """8 articles under 64 addresses each: every text is on 64 of 512 pages, but on one of 8 bodies."""
    story = lambda k: f"<div class='entry'><p>Story {k} is told at such length that it can be told apart from a date or a count.</p></div>"
    pages = [(f"http://mirror.example/{k}/{j}", f"<div class='menu'>Menu {j}</div>{story(k)}<div class='box'><p>Read us daily.</p><i>{j} views</i></div>") for k in range(8) for j in range(64)]
    got = texts_of(spark, pages)
    assert len(got) == 512 and all(f"Story {n // 64} is told" in t and "Read us" not in t and "Menu" not in t for n, t in got.items())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div class='content-sidebar-wrap'><main><p>All of it</p></main></div>", "All of it"),
        ("<div class='layout has-sidebar'><article><p>All of it</p></article><div class='sidebar'>More</div></div>", "All of it"),
        ("<div id='page' class='no-comments'><p>All of it</p></div>", "All of it"),
        ("<div class='banner'><article><p>All of it</p></article></div>", "All of it"),
        ("<div class='header'><p>All of it, at length</p><div class='share'>Share</div></div>", "All of it, at length"),
        ("<form action='/'><div><p>All of it</p></div></form>", "All of it"),
        ("<div id='content'><p>All of it</p></div><article class='card'><p>Teaser</p></article>", "All of it Teaser"),
        ("<article><p>All of it</p></article><div class='comments'><p>Much more talk than text</p></div><form><p>Mail</p></form>", "All of it"),
        ("<main><p>All of it</p></main><div id='comments'><article class='comment'><p>Much more talk than text</p></article></div>", "All of it"),
        ("<article><p>All of it</p></article><nav class='x'><a>More links than text on this page</a></nav><div class='ad-banner'>Buy</div>", "All of it"),
        ("<nav>Only links</nav><footer>us</footer>", ""),
        ("<article><p>One <img alt=\"5\" wide\"> two</p></article>", "One two"),
        ("<article><p title='a > b' data-x=\"c > d\">One 3 < 4 & 5</p></ article></article>", "One 3 < 4 & 5"),
        ("<article><p title=don't>One</p><p class='x'>two</p></article>", "One two"),
        ("<article><script data-x=\"a>b\">var a = '<p>no</p>';</script><p>One</p><iframe><p>no</p></iframe></article>", "One"),
        ("<article><p>One</p><p title=\"cut off here <b>", "One"),
        ("<article><div class='post-header'><h1>Title</h1></div><div class='social-studies'><p>Text</p></div></article>", "Title Text"),
    ],
)
def test_names_cut_no_main_text(page, want):
    assert " ".join(b.text for b in html_text.kept_blocks(html_text.parse(f"<html><body>{page}</body></html>")[0], set(), set())) == want


def style_trees(pages):
    """What trees of a host say, counted one page after another: importance of each node and of each text at it."""
    bodies = {}
    for page in pages:
        blocks, styles = html_text.parse(page)
        body = frozenset(b.text for b in blocks if not b.cut and len(b.text) >= html_text.LONG) or frozenset(b.text for b in blocks if not b.cut)
        nodes = {b.path for b in blocks}
        bodies.setdefault(body, ({(b.path, b.text) for b in blocks}, {(p, s) for p, s in styles if p in nodes}))
    nodes = {p for texts, _ in bodies.values() for p, _ in texts}
    out = {}
    for node in nodes:
        mine = [(texts, styles) for texts, styles in bodies.values() if any(p == node for p, _ in texts)]
        n = len(mine)
        if n < html_text.LEAST_PAGES:
            continue
        times = lambda k: Counter(x for pair in mine for p, x in pair[k] if p == node)  # noqa: B023, E731
        texts, looks = times(0), times(1)
        content = 1 - min(1, sum(math.log(c) for c in texts.values()) / len(texts) / math.log(n))
        total = sum(looks.values())
        look = -sum(c / total * math.log(c / total) for c in looks.values()) / math.log(n) if total else 0
        out[node] = (html_text.CONTENT * content + (1 - html_text.CONTENT) * look, {t: 1 - math.log(c) / math.log(n) for t, c in texts.items()})
    return out


def test_style_trees_equal_brute_force(spark):
    """Hosts without articles, whose frame no name tells: only the trees can cut it, and the result changes without them."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    frame = [prose(6) for _ in range(4)]
    page = lambda k: f"<div class='x1'><p>{frame[0]}</p><ul><li>{frame[1]}</li><li>{rng.choice(frame)}</li></ul></div><div class='x2'>" + "".join(f"<p>{prose(30)}</p>" for _ in range(rng.randint(1, 4))) + f"<b>{prose(3)}</b></div><div class='x3'>{frame[2]}<hr>{k % 3} stars</div>"
    pages = [page(k) for k in range(40)]
    pages += pages[:5] + [page(99).replace("x2", "z9")]
    tree = style_trees(pages)
    low = {n for n, (importance, _) in tree.items() if importance < html_text.LEAST_IMPORTANCE}
    everywhere = {(n, t) for n, (_, texts) in tree.items() for t, i in texts.items() if i < html_text.LEAST_TEXT}
    assert low or everywhere
    want = []
    for html_page in pages:
        blocks = [b for b in html_text.parse(html_page)[0] if not b.cut]
        stay = [b for b in blocks if b.prose or b.path not in low]
        rare = [b for b in stay if (b.path, b.text) not in everywhere]
        size = lambda bs: sum(len(b.text) for b in bs)
        want.append(" ".join(b.text for b in (stay if 2 * size(rare) < size(stay) else rare)))
    got = texts_of(spark, [("http://frame.example/x", p) for p in pages])
    assert [got[k] for k in range(len(pages))] == want
    assert all(frame[0] not in t and frame[2] not in t for t in want)
    whole = [" ".join(b.text for b in html_text.kept_blocks(html_text.parse(p)[0], set(), set())) for p in pages]
    assert all(a != b and frame[0] in b for a, b in zip(want, whole))
    assert html_text.main_text(spark.createDataFrame([(1, None, p) for p in [pages[0]] * 3], "page_id long, url string, html string")).count() == 3


def test_pages_of_the_test_table_keep_articles_whole(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in html_text.main_text(spark.read.parquet(f"{SMALL}/pages.parquet")).collect()}
    clean = lambda x: " ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split())
    assert set(got) == set(pages)
    for k, page in pages.items():
        heads = re.findall(r"<h1>(.*?)</h1>", page or "", re.S)
        assert all(clean(h) in got[k] for h in heads)
        assert not any(clean(x) and clean(x) in got[k] for x in re.findall(r"<footer>(.*?)</footer>", page or "", re.S))


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = {w: windows.count(w) for w in set(windows)} if len(windows) < 400 else None
    if times is None:
        times = {}
        for w in windows:
            times[w] = times.get(w, 0) + 1
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_rules_count_as_brute_force_does(spark):
    texts = TEXTS + ["a b c\n\na b c\n x\n", "a b c\r\na b c\r\n", "\n \n \n", "x\x0by\x0cz"] + [r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs_of(spark, texts, True)).collect()}
    for k, text in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(text), text
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(docs_of(spark, []).withColumn("lang", F.lit("en"))).count() == 0


def test_divergence_rejects_noise_and_keeps_prose(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    noise = spark.createDataFrame([(-1, "#$ 9x] {|} @@ 77 ;; %% " * 60 + "".join(f" q{k}%" for k in range(400)), "en")], "doc_id long, text string, lang string")
    got = quality_rules.quality_rules(docs.unionByName(noise))
    assert not got.where("doc_id = -1").first().kept
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    good = got.join(labels, "doc_id").where("NOT base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.97


def test_small_languages_have_their_own_reference(spark):
    """Clean Russian at under 0.5 % of all words, and a language with too few words for a reference."""
    rng = np.random.default_rng(3)
    russian = "который потому человек сказала только время когда больше этого очень между перед".split() + [f"слово{chr(1072 + k)}{chr(1072 + j)}" for k in range(20) for j in range(5)]
    weight = np.concatenate([np.full(12, 1 / 20), np.full(100, 0.4 / 100)])
    rows = [(k, " ".join(rng.choice(russian, 120, p=weight)), "ru") for k in range(30)]
    rows += [(100, "#$ 9x] {|} @@ 77 ;; %% " * 60 + "".join(f" q{k}%" for k in range(400)), "ru")]
    rows += [(200, " ".join(chr(945 + k // 10) * 3 + chr(945 + k % 10) for k in range(80)), "el")]
    english = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    rows += [(1000 + k, " ".join(rng.choice(english, 2000)), "en") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert all(got[k].kept and 0 < got[k].word_distance < 0.4 for k in range(30))
    assert not got[100].kept and got[200].kept and got[200].char_distance == 0
    assert len([k for k in got if k >= 1000 and got[k].kept]) == 500
    few = df.where("doc_id < 1000").withColumn("lang", F.lit(None).cast("string")).where("doc_id < 200")
    again = {r.doc_id for r in quality_rules.good_documents(few.unionByName(df.where("doc_id < 100 OR doc_id >= 1000"))).where("lang IS NULL").collect()}
    assert again == set(range(30))


def leaks(docs, items, percent=80, window=20):
    """Contaminated pairs, each item laid over each document at every place where a seed fits."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    out = set()
    for d, text in docs:
        w = words(text)
        for i, item in items:
            b = words(item)
            if not b:
                continue
            for shift in range(-len(b) + 1, len(w)):
                same = [0 <= k + shift < len(w) and w[k + shift] == x for k, x in enumerate(b)]
                hit = any(all(same[p + j] for j, c in enumerate(m) if c == "1") for m in decontamination.MASKS for p in range(len(b) - 6) if 0 <= p + shift <= len(w) - 7)
                if len(b) < decontamination.SPAN:
                    hit = any(all(same[at + j] for j, c in enumerate(m) if c == "1") for at, m in decontamination.short_masks(len(b)))
                size = min(window, len(b))
                if hit and (100 * sum(same) >= percent * len(b) or any(100 * sum(same[p : p + size]) >= percent * size for p in range(len(b) - size + 1))):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("bound", [decontamination.BROADCAST_WORDS, 0])
def test_decontamination_equals_brute_force(spark, bound):
    item = " ".join(f"w{k}" for k in range(40))
    items = [(1, item), (2, "a b c d e f"), (3, None), (4, "p q r s t u v w"), (5, item + " tail")]
    swap = item.split()
    swap[5] = swap[14] = swap[23] = "z"
    docs = [(1, f"before {item} after"), (2, " ".join(swap)), (3, item[:60]), (4, "a b c d e f"), (5, None), (6, ""), (7, "P q\nr S t u v w"), (8, " ".join(reversed(item.split()))), (9, " ".join(item.split()[10:34])), (10, "x " * 20_000)]
    df = docs_of(spark, []).unionByName(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(0))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df.withColumn("item_words", F.lit(1)), bench, broadcast_words=bound).collect()}
    assert got == leaks(docs[:-1], items)
    kept = {r.doc_id for r in decontamination.clean_documents(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert decontamination.contaminated(df.where("false"), bench).count() == 0 == decontamination.contaminated(df, bench.where("false")).count()


def overlaps(docs, items, percent=80, window=20):
    """Contaminated pairs, each item laid over each document at every place, without seeds."""
    out = set()
    for d, text in docs:
        w = text.lower().split()
        for i, item in items:
            b = item.lower().split()
            size = min(window, len(b))
            for shift in range(-len(b) + 1, len(w)):
                same = [0 <= k + shift < len(w) and w[k + shift] == x for k, x in enumerate(b)]
                if 100 * sum(same) >= percent * len(b) or any(100 * sum(same[p : p + size]) >= percent * size for p in range(len(b) - size + 1)):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("bound", [decontamination.BROADCAST_WORDS, 0])
def test_no_permitted_substitution_is_without_a_seed(spark, bound):
    sizes = [1, 2, 3, 4, 5, 6, 7, 8, 10]
    items = [(n, " ".join(f"s{n}w{k}" for k in range(n))) for n in [*sizes, 15, 16, 17]]
    gaps = [(n, c) for n in sizes for r in (0, 1, 2) for c in itertools.combinations(range(n), r)]
    gaps += [(15, (2, 7, 12)), (15, (3, 7, 12)), (15, (4, 7, 12)), (16, (3, 8, 13)), (16, (4, 8, 12)), (17, (4, 8, 12))]
    docs = []
    for n, gap in gaps:
        text = " ".join("z" if k in gap else f"s{n}w{k}" for k in range(n))
        docs += [(2 * len(docs), text), (2 * len(docs) + 1, f"before {text} after")]
    docs += [(-1, "s7w0 s7w1 s7w2 s7w3 s7w4 s7w5"), (-2, "s5w1 s5w2 s5w3 s5w4 x"), (-3, "x s6w0 s6w1 s6w2 s6w3 s6w4")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (99, " ")], "item_id long, text string")
    want = overlaps(docs, items)
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench, broadcast_words=bound).collect()}
    assert got == want
    if bound:
        kept = {r.doc_id for r in decontamination.clean_documents(df, bench).collect()}
        assert kept == {d for d, _ in docs} - {d for d, _ in want}


@pytest.mark.parametrize(("bound", "hits"), [(decontamination.BROADCAST_WORDS, decontamination.BROADCAST_HITS), (0, 0)])
def test_repeated_words(spark, bound, hits):
    """Runs of one word, words in turn, and runs broken by others: each shift once, and no more than a range of them for two runs."""
    rng = random.Random(bound)
    docs = [(1, "the " * 400), (2, "ha ho " * 120), (3, "x " + "the " * 70 + "y"), (4, "the " * 9 + "a " + "the " * 12), (5, "the the"), (6, "the"), (6, "ha ho ha ho the the the the the the the the"), (None, "the " * 80), (None, "ho " * 300)]
    docs += [(10 + k, " ".join(rng.choice(["the", "the", "the", "ha"]) for _ in range(60))) for k in range(12)]
    items = [(1, "the " * 100), (2, "ho ha " * 20), (3, "the " * 8), (4, "the the the the the"), (5, "ha"), (6, " ".join(["the"] * 20 + ["ha"] * 5 + ["the"] * 20))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench, broadcast_words=bound, broadcast_hits=hits).collect()}
    assert got == overlaps(docs, items)


def test_many_documents_of_one_word(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the "), 2000).alias("text"))
    bench = spark.createDataFrame([(1, "the " * 200)], "item_id long, text string")
    assert decontamination.contaminated(docs, bench).where("n_match = 200 AND best_window = 20").count() == 300


def test_more_references_than_one_pass_holds(spark, monkeypatch):
    """Documents without a language are compared with all references, however many there are."""
    rng = np.random.default_rng(6)
    languages = [[f"{chr(97 + n // 26)}{chr(97 + n % 26)}w{k}" for k in range(20)] for n in range(7)]
    rows = [(100 * n + k, " ".join(rng.choice(words, 300)), f"l{n}") for n, words in enumerate(languages) for k in range(10)]
    rows += [(1000 + n, " ".join(rng.choice(words, 300)), None) for n, words in enumerate(languages)] + [(2000, "#$% 77 {|} " * 60 + " ".join(f"q{k}%" for k in range(400)), "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = sorted(map(tuple, quality_rules.quality_rules(df).collect()))
    assert {r[0] for r in whole if not r[7] and r[0] >= 1000} == {2000}
    for at_once in (1, 3, 6):
        monkeypatch.setattr(quality_rules, "AT_ONCE", at_once)
        assert sorted(map(tuple, quality_rules.quality_rules(df).collect())) == whole
    assert {r.doc_id for r in quality_rules.good_documents(df).where("doc_id >= 1000").collect()} == {1000 + n for n in range(7)}


def labelled(spark, label, folds, held):
    """Labelled texts outside the held-out fold, in order of their ids."""
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r[label] is not None and zlib.crc32(str(r.doc_id).encode()) % folds != held}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    return [(d, texts[d] or "", labels[d]) for d in sorted(labels) if d in texts], texts


def newton(gradient_and_curve, width):
    """The lowest place of a convex loss."""
    w = np.zeros(width)
    for _ in range(60):
        g, h = gradient_and_curve(w)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-10:
            return w
    raise AssertionError("no convergence")


def plain_features(text):
    """The features of op3, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = max(len(words), 1)
    classes = [0] * 8
    for c in text:
        kind = 7 if ord(c) > 127 else 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\v\f\r" else 4 if c in ".,;:?'\"()-" else 5 if c in "#*$%&|<>" else 6
        classes[kind] += 1
    _, chars, symbols, dup, repeated, _ = base_counts(text)
    marks = [sum(text.count(c) for c in m) / n for m in ("!", "|", "@/\\_=+~^", "{}[]()", "\"'")]
    sizes = [len(w.encode()) for w in words]
    different = len(set(words)) / n
    return [
        math.log1p(len(words)), *(k / max(sum(classes), 1) for k in classes), *(min(m, 1) for m in marks), min(symbols / n, 2), repeated / n, math.log1p(dup), chars / n / 10,
        sum(a == b for a, b in itertools.pairwise(words)) / n, sum(s <= 3 for s in sizes) / n, sum(s == 1 for s in sizes) / n, sum(s > 25 for s in sizes) / n,
        different * math.log1p(len(words)) / 5, different, min(symbols / n, 0.05) * 20, min(marks[1], 0.05) * 20, min(marks[0], 0.05) * 20, min(repeated / n, 0.2) * 5,
    ]


def test_quality_scores_equal_a_plain_fit(spark):
    """Features word by word, and the lowest loss over the same preference pairs."""
    rows, texts = labelled(spark, "quality", 3, 1)
    x, y = np.array([plain_features(t) for _, t, _ in rows]), np.array([label for _, _, label in rows])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -6, 6)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng, many = np.random.default_rng(17), max(len(good), len(bad)) * quality_model.PAIRS_EACH
    better, worse = (np.concatenate([rng.permutation(side) for _ in range(-(-many // len(side)))])[:many] for side in (good, bad))
    pairs = z[better] - z[worse]

    def loss(w):
        p = 1 / (1 + np.exp(-pairs @ w))
        return pairs.T @ (p - 1) / many + quality_model.RIDGE * w, (pairs * (p * (1 - p))[:, None]).T @ pairs / many + quality_model.RIDGE * np.eye(len(w))

    w = newton(loss, x.shape[1])
    s = np.sort(z @ w)
    split = lambda q: ((z[good] @ w > np.quantile(s, q)).mean() + (z[bad] @ w <= np.quantile(s, q)).mean(), -abs(q - len(bad) / len(y)))
    at = np.quantile(s, max(np.linspace(0.002, 0.998, 499), key=split))
    at = (s[s > at][0] + s[s <= at][-1]) / 2
    got = {r.doc_id: r for r in queries.op3_quality(spark, SMALL).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        want = 1 / (1 + math.exp(-np.clip(np.clip((np.array(plain_features(t or "")) - mean) / scale, -6, 6) @ w - at, -40, 40)))
        assert abs(got[d].score - want) < 1e-5 and got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)


def test_toxicity_scores_equal_a_plain_fit(spark):
    """Vocabulary by chi-square, and the lowest loss with the counterfactual penalty, in dense matrices."""
    rows, texts = labelled(spark, "toxic", 5, 0)
    words_of = lambda t: set(re.findall(r"\w+", t.lower()))

    def features(words):
        starts = [w[:4] + "*" for w in words if len(w) > 4] + [w[:5] + "*" for w in words if len(w) > 5]
        return words | set(starts) | {s + "2" for s in starts if starts.count(s) > 1} | {s + "d" for s in starts if starts.count(s) > max(1, len(words) / 100)}

    own = [features(words_of(t)) for _, t, _ in rows]
    y = np.array([label for _, _, label in rows], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    seen = [Counter(f for fs, label in zip(own, y) if label == k for f in fs) for k in (1, 0)]
    chi = {}
    for f in set(seen[0]) | set(seen[1]):
        a, b = seen[0][f], seen[1][f]
        c, d = n1 - a, n0 - b
        value = (a * d - b * c) * (a * d - b * c) * (n0 + n1) / ((a + b) * max(c + d, 0.5) * n1 * n0)
        if a + b >= toxicity.LEAST_DOCS and value > 10 and a / n1 > b / n0:
            chi[f] = value
    chosen = sorted(chi, key=lambda f: (-chi[f], f))[: toxicity.VOCABULARY]
    names = sorted(set(chosen) | {f for w in toxicity.NEXT_TERM for f in features({w})})
    column = {f: k for k, f in enumerate(names)}

    def dense(sets):
        out = np.zeros((len(sets), len(names) + 1))
        for k, fs in enumerate(sets):
            out[k, [column[f] for f in fs if f in column]] = 1
        out[:, -1] = 1
        return out

    x = dense(own)
    swaps = [(k, {toxicity.NEXT_TERM.get(w, w) for w in words_of(t)}) for k, (_, t, _) in enumerate(rows)]
    swaps = [(k, s) for k, s in swaps if s != words_of(rows[k][1])]
    moved = x[[k for k, _ in swaps]] - dense([features(s) for _, s in swaps]) if swaps else np.zeros((0, x.shape[1]))
    weight = np.where(y == 1, np.sqrt(n0 / n1), 1.0)
    weight *= len(y) / weight.sum()
    ridge = np.append(np.full(len(names), toxicity.RIDGE), 0)
    balance = 2 * toxicity.BALANCE / max(len(swaps), 1)

    def loss(w):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (weight * (p - y)) / len(y) + ridge * w + balance * moved.T @ (moved @ w)
        return g, (x * (weight * p * (1 - p) / len(y))[:, None]).T @ x + np.diag(ridge + 1e-12) + balance * moved.T @ moved

    w = newton(loss, x.shape[1])
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, SMALL).collect()}
    some = sorted(texts)
    want = 1 / (1 + np.exp(-dense([features(words_of(texts[d] or "")) for d in some]) @ w))
    assert set(got) == set(texts)
    assert np.abs(np.array([got[d].score for d in some]) - want).max() < 0.01


@pytest.mark.parametrize("run", [quality_model.quality_scores, toxicity.toxicity_scores])
def test_repeated_rows_are_scored_each(spark, run):
    label = "quality" if run is quality_model.quality_scores else "toxic"
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    extra = docs.limit(20).withColumn("text", F.lit(None).cast("string"))
    got = run(docs.unionByName(docs.limit(20)).unionByName(extra), labels, label).collect()
    assert len(got) == docs.count() + 40 and all(0 <= r.score <= 1 for r in got)


def test_divergence_equals_plain_histograms(spark):
    """Distances by counting characters and words of each language one by one."""
    docs = [(r.doc_id, r.text or "", r.lang or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    kinds = [set(map(chr, range(97, 123))), set(map(chr, range(65, 91))), set("0123456789"), set(" \t\n\v\f\r"), set(".,;:?'\"()-"), set("#*$%&|<>")]

    def chars(text):
        c = Counter(next((k for k, s in enumerate(kinds) if x in s), 6 if ord(x) < 128 else 7) for x in text)
        return [c[k] for k in range(8)]

    def words(text):
        small = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        return [w[:-1] if len(w) > 1 and w[-1] in ".,!?" else w for w in small]

    def distance(p, q):
        p, q = np.array(p, float) / max(sum(p), 1), np.array(q, float) / max(sum(q), 1)
        m = (p + q) / 2
        return math.sqrt(max(0, sum(sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0) for x in (p, q)) / 2))

    refs = {}
    for lang in {r[2] for r in docs}:
        count = Counter(w for _, t, x in docs if x == lang for w in words(t))
        if count.total() >= quality_rules.LEAST_WORDS:
            ranked = count.most_common()
            beyond = ranked[quality_rules.COMMON][1] if len(ranked) > quality_rules.COMMON else 0
            top = [w for w, n in ranked if n > beyond]
            refs[lang] = (np.sum([chars(t) for _, t, x in docs if x == lang], 0), top, [count[w] for w in top] + [count.total() - sum(count[w] for w in top)])
    assert refs
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    for d, t, lang in docs:
        if lang in refs:
            c = Counter(words(t))
            mine = [c[w] for w in refs[lang][1]]
            assert abs(got[d].char_distance - distance(chars(t), refs[lang][0])) < 1e-6
            assert abs(got[d].word_distance - distance([*mine, c.total() - sum(mine)], refs[lang][2])) < 1e-6


def thue_morse(n):
    """A text and its mirror: hashes modulo a power of two can't tell them apart."""
    text = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return [text, text.translate(str.maketrans("ab", "ba"))]


def test_texts_that_fool_hashes_modulo_powers_of_two(spark):
    words = [t for n in (1024, 2048, 4096, 16384) for t in thue_morse(n)]
    texts = [*words, *("\n".join(["x y", t, u, t]) for t, u in zip(words[::2], words[1::2])), *(" ".join([*thue_morse(1024), "z"] * 3) for _ in range(1)), " ".join(["p q", words[0], "r", "p q", words[1], "r"])]
    lib = library()
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in bpe.encode_documents(docs, PATH, with_ids=True).collect()}
    files = {r.doc_id: r for r in token_files.token_files(docs, PATH).collect()}
    rules = {r.doc_id: r for r in quality_rules.quality_rules(docs.withColumn("lang", F.lit("en"))).collect()}
    for k, text in enumerate(texts):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids
        assert got[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert files[k].ids_crc32 == zlib.crc32(np.array([*ids, 0], "<u4").tobytes())
        r = rules[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(text)


def test_pieces_under_one_hash_keep_their_own_ids():
    class OneHash(bpe.Pieces):
        @staticmethod
        def _keys_of(raw, start, end):
            return np.where(end - start > 7, np.uint64((1 << 63) | 5), bpe.Pieces._keys_of(raw, start, end))

    voc, lib = bpe.vocabulary(PATH), library()
    pieces = OneHash(voc.merge)
    for _ in range(2):
        raw = np.frombuffer(" ".join(["wonderful", "different", "considerable", "wonderful", "x" * 40, "yes"] * 2).encode(), np.uint8)
        ids, _ = bpe.encode_step(raw, np.array([0, len(raw)]), pieces, voc.added)
        assert ids.tolist() == lib.encode(raw.tobytes().decode(), add_special_tokens=False).ids


def test_trees_of_plain_numbers_equal_the_library():
    rng = random.Random(5)
    voc, lib = bpe.vocabulary(PATH), library()
    for n in (1, 2, 17, 300, 20_000):
        text = "".join(rng.choice("etaoinshrdlu") for _ in range(n))
        assert voc._tree(np.frombuffer(text.encode(), np.uint8)).tolist() == lib.encode(text, add_special_tokens=False).ids
