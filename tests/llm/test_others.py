"""The other operators against plain versions, round trips and held-out accuracy."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tests.oracle import compare, duck
from tidemark.llm import chat_format, decontaminate, html_extract, quality_classifier, quality_rules, queries, sentencepiece_scan, token_bins
from tidemark.llm import kernels as K

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "it's  we'll\t\nI've 've 'sx '", "é中文😀   x", "x" * 3000, "▁a ▁▁b", "<|endoftext|> z", "1 22 333 ½ ٣", "\x00\x01", "A  B " * 400]


def frame(spark, texts, extra=""):
    return spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id int, text string, score string")


def found(df, *names):
    return {r.doc_id: tuple(r[n] for n in names) for r in df.collect()}


# decontamination


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs far away into the deep woods"), (2, "Short item, here"), (2, "Short item, here"), (None, "a b c d e f g h i j k l m n"), (4, None), (5, "... !"), (10, "short ITEM here")]
TEXTS = [None, "", "nothing", "say: short-item here!", "x " * 30 + "the quick brown fox jumps over the lazy dog and runs far away now", "a b c d e f g h i j k l m n", "Short item here " * 3 + "y " * 400]


#: One block, a few, and one for each item.
BOUNDS = [64 << 20, 500, 10]


@pytest.mark.parametrize("bound", BOUNDS)
def test_contamination(spark, bound):
    docs = frame(spark, TEXTS)
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    items = [("" if i is None else i, t) for i, t in ITEMS]
    want = brute.contamination(list(enumerate(TEXTS)), items)
    got = found(decontaminate.score_contamination(docs, bench, max_broadcast_bytes=bound), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == want
    stays = {r.doc_id for r in decontaminate.decontaminate(docs, bench, max_broadcast_bytes=bound).collect()}
    assert stays == {k for k, v in want.items() if not v[-1]}


@pytest.mark.parametrize("bound", BOUNDS)
def test_contamination_by_row(spark, bound):
    """Null and repeated ids: only the contaminated rows go."""
    bad, good = TEXTS[4], "nothing of it"
    rows = [(None, bad, "a"), (None, good, "b"), (None, None, "c"), (7, good, "d"), (7, bad, "e"), (7, good, "d"), (8, bad, "f")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, tag string").repartition(3)
    out = decontaminate.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id int, text string"), max_broadcast_bytes=bound)
    assert out.columns == docs.columns
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(x) for x in rows if x[1] != bad)


@pytest.mark.parametrize("bound", BOUNDS)
def test_contaminated_spans_go(spark, bound):
    docs, bench = frame(spark, TEXTS), spark.createDataFrame(ITEMS, "item_id int, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, "spans", max_broadcast_bytes=bound).collect()}
    assert got == {0: None, 1: "", 2: "nothing", 3: "say: !", 4: "x " * 30 + " now", 5: "", 6: " " + "y " * 400}
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench, "other")


@pytest.mark.parametrize("bound", BOUNDS)
def test_spans_of_several_blocks_are_cut_at_once(spark, bound):
    """Windows of two items overlap, a cut brings a third window together, ids are null and repeated: no hit is left, rows stay apart."""
    items = [(1, "a b c d"), (2, "c d e f"), (3, "p q r"), (4, "g h")]
    texts = ["x a b c d e f y " + "z " * 200, "p a b c d q r " + "z " * 200, "g h", "G-H a b q", None, "p a b g h c d q r " + "z " * 200]
    rows = [(i, t, f"tag{j}") for j, (i, t) in enumerate(zip([None, None, 7, 7, 7, 7], texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["size"]: (r.doc_id, r.text) for r in decontaminate.decontaminate(docs, bench, "spans", max_broadcast_bytes=bound).collect()}
    z = "z " * 200
    assert got == {"tag0": (None, "x  y " + z), "tag1": (None, " " + z), "tag2": (7, ""), "tag3": (7, " a b q"), "tag4": (7, None), "tag5": (7, " " + z)}
    both = decontaminate.decontaminate(docs, bench, "both", max_broadcast_bytes=bound)
    assert both.columns == docs.columns
    assert {r["size"]: (r.doc_id, r.text) for r in both.collect()} == {k: v for k, v in got.items() if k in ("tag0", "tag1", "tag4", "tag5")}


def test_window_set_is_flat():
    """What a set takes is what its bound counts, and equal hashes are told apart by their words."""
    rng = random.Random(3)
    items = [(str(i), " ".join(f"w{rng.randrange(5000)}" for _ in range(400))) for i in range(200)]
    windows = decontaminate.WindowSet(items)
    cost = sum(len(t) + 24 * 400 + 60 + len(i) for i, t in items)
    assert windows.nbytes() <= cost + sum(b.nbytes for b in windows.bits.values()) and windows.nbytes() < 8 * sum(len(t) for _, t in items)
    size = next(iter(windows.windows))
    h, place, length, item = windows.windows[size]
    windows.windows[size] = (np.zeros_like(h), place, length, item)  # all hashes meet
    windows.bits[size][:] = True
    data, starts, ends = decontaminate._item_words(items[3][1])
    K_zero = decontaminate.K.window_hashes
    decontaminate.K.window_hashes = lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64)
    try:
        found = windows.find(data, starts[:20], ends[:20], np.zeros(20, np.int64))
    finally:
        decontaminate.K.window_hashes = K_zero
    assert [(k, n, x) for k, n, x in found] == [(k, 13, {"3"}) for k in range(8)]


def test_contamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(decontaminate.score_contamination(frame(spark, ["a b"]), none), "n_hit", "contaminated") == {0: (0, False)}
    assert decontaminate.score_contamination(frame(spark, []), none).count() == 0


def test_contamination_oracle(spark):
    assert compare(queries.QUERIES["op8_decontamination"](spark, SF), duck(SF), queries.ORACLE_SQL["op8_decontamination"]) == 200


# quality rules


def test_statistics(spark):
    texts = ODD + ["a b c a b c a b c", "p q r s\np q r s\n\n \np q r s", "#*$%&|<> !", "w " * 60, "\n".join(["same line"] * 5)] + ["　x\xa0y"]
    got = found(quality_rules.quality_rules(frame(spark, texts)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute.statistics(t) for i, t in enumerate(texts)}


def test_rules_on_documents(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op10_quality_rules"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.statistics(d.text)
        assert not (r.base_failed and r.kept)


def test_rules_against_labels(spark):
    """Kept follows the labels, which the rules never read."""
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op10_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r["quality"] == 0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = [(r.kept, labels[r.doc_id]) for r in got]
    assert np.mean([k for k, q in kept if q == 1]) > 0.98 and np.mean([k for k, q in kept if q == 0]) < 0.1


def test_em():
    votes = [((0, -1), 50), ((-1, 1), 900), ((-1, -1), 50)]
    share, rates = quality_rules.fit(votes)
    assert quality_rules.posterior((0, -1), share, rates) < 0.5 < quality_rules.posterior((-1, 1), share, rates)
    assert quality_rules.fit([]) == (quality_rules.START_GOOD, [quality_rules.START_RATES] * len(quality_rules.RULES))


def test_posterior_by_row(spark):
    """The verdict of every document equals that of a plain EM over single documents, from the rules worked out in Python."""
    from math import exp, log

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(1000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}

    def votes(text):
        n, chars, symbols, dup, rep, _ = brute.statistics(text)
        text = text or ""
        lines = [x for x in text.split("\n") if brute.SPACED.search(x)]
        runs, upper, marks = len(__import__("re").findall(r"[#*$%&|<>]+", text)), sum("A" <= c <= "Z" for c in text), text.count("!")
        if n == 0:
            return (0,) + (-1,) * 8
        bad = [n < 50, symbols > 0.1 * n, runs > 0.05 * n, rep > 0.3 * n, dup > 0.5 * len(lines), chars < 2 * n or chars > 12 * n, upper > 0.4 * chars, marks > 0.2 * n, False]
        good = [100 <= n <= 100_000, *[False] * 7, symbols <= 0.01 * n and upper <= 0.1 * chars and marks <= 0.02 * n and rep <= 0.1 * n]
        return tuple(0 if b else 1 if g else -1 for b, g in zip(bad, good))

    v = {k: votes(t) for k, t in docs}
    share, rates = 0.85, [[[0.4, 0.02], [0.3, 0.6]] for _ in range(9)]  # rates[rule][vote] = on bad, on good documents

    def quality(x):
        p_bad, p_good = log(1 - share), log(share)
        for r, y in zip(rates, x):
            if y >= 0:
                p_bad += log(max(r[y][0], 1e-6))
                p_good += log(max(r[y][1], 1e-6))
        return 1 / (1 + exp(min(700, p_bad - p_good)))

    for _ in range(quality_rules.ROUNDS):
        q = {k: quality(x) for k, x in v.items()}
        good = sum(q.values())
        new = []
        for i in range(9):
            rule = []
            for y in (0, 1):
                start = (0.4, 0.02) if y == 0 else (0.3, 0.6)
                on_bad = (start[0] + sum(1 - q[k] for k, x in v.items() if x[i] == y)) / (len(v) - good + 1)
                on_good = (start[1] + sum(q[k] for k, x in v.items() if x[i] == y)) / (good + 1)
                rule.append([max(on_bad, on_good), on_good] if y == 0 else [min(on_bad, on_good), on_good])
            new.append(rule)
        share, rates = min(0.999, max(0.001, good / len(v))), new
    for k, x in v.items():
        assert abs(got[k].quality - quality(x)) < 1e-6, (k, x)
        assert got[k].kept == (not got[k].base_failed and quality(x) >= 0.5)


def test_rules_run_no_python(spark):
    plan = queries.QUERIES["op10_quality_rules"](spark, SF)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0


# classifier


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op5_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.99
    assert np.mean([r.predicted == r.quality for r in got]) > 0.97


def test_classifier_odd_texts(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (5, None), (None, 1), (99, 1)], "doc_id int, quality int")
    got = found(quality_classifier.score_quality(docs, labels), "held_out", "score", "predicted")
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= s <= 1 and p == (s >= 0.3) for i, (h, s, p) in got.items()) and len(got) == len(ODD)
    assert got[0][1] == got[1][1]
    none = spark.createDataFrame([], "doc_id int, quality int")
    assert set(r[1] for r in found(quality_classifier.score_quality(docs, none), "held_out", "score").values()) == {0.5}
    assert quality_classifier.score_quality(frame(spark, []), labels).count() == 0
    assert quality_classifier.keep_good(docs, none).columns == docs.columns


def test_features():
    data = "a b a\nÄ!! !!".encode()
    doc, i, x = quality_classifier.features(np.frombuffer(data + data, np.uint8), np.array([0, len(data), 2 * len(data)]))
    half = len(doc) // 2
    assert (i[:half] == i[half:]).all() and np.allclose((x[doc == 0] ** 2).sum(), 1)
    assert half == 4 + 5  # a b Ä !! and their neighbours, of which "!! !!" is the same token twice


# token files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))


def test_packing():
    for w in (1, 3, 8, 13, 16, 17, 31, 32):
        for n in (0, 1, 7, 8, 9, 1001):
            ids = np.random.RandomState(w).randint(0, 1 << w, n, dtype=np.uint64).astype(np.uint32)
            raw = token_bins.pack(ids, w)
            assert len(raw) == (n * w + 7) // 8 and (token_bins.unpack(raw, n, w) == ids).all()
    assert [token_bins.width_of(v) for v in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def test_random_access(tmp_path):
    ids = np.arange(10_000, dtype=np.uint32) % 5000
    with pa.OSFile(str(tmp_path / "x.bin"), "wb") as f:
        w = token_bins.BinWriter(f, 13, block_ids=64)
        for a in range(0, 10_000, 1250):
            w.add(np.array([a, a + 1]), ids[a : a + 1250], np.array([1000, 250]))
        w.close()
    with pa.OSFile(str(tmp_path / "x.bin"), "rb") as f:
        r = token_bins.BinReader(f)
        for a, b in ((0, 10_000), (0, 0), (63, 65), (5000, 5001), (9999, 10_000), (100, 7777)):
            assert (r.read_ids(a, b) == ids[a:b]).all()
        assert r.docs[:4].tolist() == [0, 1, 1250, 1251] and r.starts[:3].tolist() == [0, 1000, 1250]


def test_encoder(tokenizer):
    rng = random.Random(4)
    signs = "ab's  t\n\t're 've'll 'd'm1²٣ é!? 　 \r\n中文😀́x"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for room in (1 << 16, 40):
        encoder, got = token_bins.Encoder(tokenizer, room), []
        for _, _, data, off in K.blocks(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), most=2000):
            ids, n = encoder.block(data, off)
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_whose_hashes_meet(tokenizer, monkeypatch):
    """Blocks in which different pieces have one hash are encoded right all the same."""
    real = K.span_hashes
    monkeypatch.setattr(K, "span_hashes", lambda data, a, b: real(data, a, b) % np.uint64(5))
    texts = ["some words and others, and some more", "ab cd ef gh ij", "", "some some"]
    data, off = K.utf8(pa.array(texts))
    ids, n = token_bins.Encoder(tokenizer, 100).block(data, off)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_file_systems(tmp_path):
    assert token_bins._filesystem(f"file://{tmp_path}/x")[1] == f"{tmp_path}/x"
    with pytest.raises(ValueError, match="viewfs"):
        token_bins._filesystem("viewfs://a/b")


def test_token_files(spark, tokenizer):
    rows = [(7, "b"), (7, "a"), (None, "null id"), (3, None), *[(i + 10, t) for i, t in enumerate(ODD)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(token_bins.token_digest(df, queries.vocabulary("byte_bpe_50k.json")).collect(), key=lambda r: r.start)
    start = 0
    for (i, t), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), brute.crc(ids))
        start += len(ids)
    assert token_bins.token_digest(df.where("false"), queries.vocabulary("byte_bpe_50k.json")).count() == 0


# SentencePiece


def test_sentencepiece(spark, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece_scan, "CHUNK", 90)
    monkeypatch.setattr(sentencepiece_scan, "FAN", 3)
    rng = random.Random(6)
    parts = ["a", "b", "th", "in", "the", "er", " ", "  ", "\n", "é", "中", "▁", "ing", "1", "23", "==", "龘", "    "]
    texts = ODD + ["".join(rng.choice(parts[: 6 if k % 2 else 18]) for _ in range(rng.randint(50, 900))) for k in range(40)] + ["e" * 2000]
    path = queries.vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    out = sentencepiece_scan.encode(frame(spark, texts), path, giant=200)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids, i
        assert (got[i].n_tokens, got[i].ids_crc32, got[i].n_chunks) == (len(ids), brute.crc(ids), -(-len(t) // 90) if t and len(t) > 200 else 1)
    back = {r.doc_id: r.text for r in sentencepiece_scan.decode(out, path).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") and got[i].round_trip for i, t in enumerate(texts))
    assert sentencepiece_scan.encode(frame(spark, []), path).count() == 0


def test_max_plus_product():
    a, b = np.array([[0.0, -np.inf], [-1.0, 2.0]]), np.array([[1.0, -np.inf], [0.0, 5.0]])
    assert sentencepiece_scan.plus(a, b).tolist() == [[1.0, -np.inf], [2.0, 7.0]]


# HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><header class=top>Site</header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>First   <b>bold</b>
para&#233;graph<br>goes on.<p>Second.</p><div class="ad">Buy now</div><ul><li>One<li>Two</ul><table><tr><td>Cell</td></tr></table><form>Name <input><button>Go</button></form></article>
<aside>Related</aside><section id="comments"><p>Nice post</p></section><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Head & line\nFirst bold paraégraph goes on.\nSecond.\nOne\nTwo\nCell"
    for empty in (None, "", "<p> </p>", "<nav>only</nav>", "<script>x"):
        assert html_extract.main_text(empty) == ""
    assert html_extract.main_text("plain &lt;text&gt;") == "plain <text>"


def test_marks_inside_an_article():
    inner = '<div class="post-header"><h1>Title</h1></div><div class="side-by-side">Text</div><div class="comment-list">Nice</div><div id="ad_1">Buy</div><section class="related-posts">More</section><p hidden>Gone</p><p>End</p>'
    assert html_extract.main_text(f'<body><div class="page-header">Site</div><article class="post">{inner}</article></body>') == "Title\nText\nEnd"


def test_main_text_by_ratio():
    link = "<div><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div>"
    para = "<p>" + "word " * 60 + "</p>"
    assert html_extract.main_text(f"<body>{link * 4}<h2>Title</h2>{para * 3}{link * 4}</body>") == "\n".join(["Title"] + [("word " * 60).strip()] * 3)


def test_ratio_decides_on_marked_pages_too():
    text = ("word " * 60).strip()
    para, teaser = f"<p>{text}</p>", "<article><a href=1>More</a> <a href=2>on</a> <a href=3>this</a></article>"
    few = "<div><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div>"
    assert html_extract.main_text(f"<body>{teaser * 4}{few * 2}{para * 3}{few * 2}{teaser * 4}</body>") == "\n".join([text] * 3)
    assert html_extract.main_text(f"<body>{few * 3}<article><h1>T</h1>{para * 2}<p>End.</p></article>{para * 2}{few * 3}</body>") == "\n".join(["T", text, text, "End.", text, text])
    assert html_extract.main_text(f"<body><main>{teaser * 4}{few}{para * 3}{few}<p>End.</p></main></body>").split("\n")[1:-2] == [text] * 3


def test_pages_without_marks(spark):
    """Without the article's mark (renamed, or taken away) the ratio and its regions find the same text; without any names at all they find it, and some notices."""
    import re
    from collections import Counter

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    want = [html_extract.main_text(h) for h in pages]
    assert [html_extract.main_text(re.sub(r"<(/?)article>", r"<\1div>", h)) for h in pages] == want
    assert [html_extract.main_text(re.sub(r"</?article>", "", h)) for h in pages] == want
    bare = [re.sub(r'\s(class|id|role)="[^"]*"', "", re.sub(r"<(/?)(article|main|nav|aside|footer|header|section)\b", r"<\1div", h)) for h in pages]
    found, hit, due = 0, 0, 0
    for h, t in zip(bare, want):
        a, b = Counter(html_extract.main_text(h).split("\n")), Counter(t.split("\n"))
        found, hit, due = found + a.total(), hit + (a & b).total(), due + b.total()
    assert hit == due and hit > 0.8 * found


def test_long_and_deep_pages():
    para = "<p>" + "word " * 60 + "</p>"
    assert html_extract.main_text("<div>" * 50_000 + para + "</span>" * 50_000) == ("word " * 60).strip()
    assert html_extract.main_text("<b>" * 50_000 + para * 3).count("\n") == 2
    assert html_extract.main_text("<article>" + para * 20_000 + "</article>").count("\n") == 19_999


def test_smoothing_and_threshold():
    r = np.array([0.0, 0, 10, 10, 10, 0, 0])
    s = html_extract.smoothed(r)
    assert len(s) == 7 and s[3] == s.max() and s[2] > s[1] > s[0] and np.allclose(html_extract.smoothed(np.ones(5)), 1)
    assert html_extract.threshold(np.array([1.0, 1, 2, 9, 10])) == 9 and html_extract.threshold(np.array([3.0])) == 3


def test_pages(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 2)]
    got = sorted(html_extract.extract_main_text(spark.createDataFrame(rows, "page_id int, url string, html string, text int")).collect(), key=str)
    assert [(r.page_id, r.n_chars) for r in got if r.page_id] == [(1, len(html_extract.main_text(PAGE)))] * 2
    assert [(r.text, r.n_chars) for r in got if not r.page_id] == [("", 0)]
    out = queries.QUERIES["op7_html_extract"](spark, SF).collect()
    assert all(r.text and r.n_chars == len(r.text) and "track(" not in r.text and "©" not in r.text for r in out)


# chats


CHAT = [
    (1, 0, "user", "Hello there friend\nHow are you today?"), (1, 1, "assistant", "> How are you  TODAY?\nFine, thanks.\n\nAnd you?"), (1, 2, "user", "Bob wrote:\n> Fine, thanks.\n> > How are you today?\nGood to hear"),
    (1, 2, "user", "Bob wrote:\n> Fine, thanks.\n> > How are you today?\nGood to hear"), (1, 3, "assistant", "no quotes, he wrote:"), (2, 0, "user", "> Good to hear\nAcross"), (2, 1, "user", None), (2, 2, None, ""), (None, 1, "user", "> Good to hear"),
    (3, 0, "user", "> unknown line\nx"), (3, 1, "user", "yes\nsame"), (3, 2, "user", "yes\nother"), (3, 3, "user", ">yes\n>same\nA"), (3, 4, "user", ">yes\nB"),
]


def test_links(spark):
    m = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    links = {(r.conv_id, r.turn, r.passage): (r.level, r.lines, r.linked, r.to_conv, r.to_turn) for r in chat_format.quote_links(m).collect()}
    assert links == {(1, 1, 0): (1, 1, 1, 1, 0), (1, 2, 1): (1, 1, 1, 1, 1), (1, 2, 2): (2, 1, 1, 1, 0), (2, 0, 0): (1, 1, 1, 1, 2), (3, 0, 0): (1, 1, 0, None, None), (3, 3, 0): (1, 2, 1, 3, 2), (3, 4, 0): (1, 1, 1, 3, 2)}


def test_chats(spark, tmp_path):
    m = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumn("root_turn", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x"))
    got = chat_format.format_chat(m).collect()
    assert len(got) == len(CHAT)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 1].text == "Fine, thanks.\n\nAnd you?" and by[1, 2].text == "Good to hear" and by[1, 3].text == "no quotes, he wrote:"
    assert by[2, 1].text is None and by[2, 2].text == "" and by[2, 2].formatted == "<|unknown|>\n<|end|>\n" and by[None, 1].text == ""
    assert [(by[k].root_conv, by[k].root_turn) for k in ((1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (3, 0))] == [(1, 0), (1, 0), (1, 0), (1, 3), (1, 0), (3, 0)]
    chat_format.write_chats(m, f"file://{tmp_path}/chats")
    text = "".join(p.read_text() for p in sorted((tmp_path / "chats").glob("part-*")))
    assert text.count("<|end|>") == len(CHAT) and text.index("Hello there") < text.index("Fine, thanks") < text.index("Across") < text.index("no quotes")
    assert chat_format.format_chat(m.where("false")).count() == 0


def test_chats_in_order(spark):
    """A long thread, a line that very many quote, a cycle across conversations, and carriage returns: positions follow the replies."""
    rows = [(1, t, "user", f"line {t}\r\nand more" if not t else f"> line {t - 1}\r\nline {t}") for t in range(300)]
    rows += [(2, 0, "user", "hot line")] + [(2 + i, 1, "user", f"> hot line\nanswer {i}") for i in range(1, 120)]
    rows += [(900, 0, "user", "> from b\nfrom a"), (901, 0, "user", "> from a\nfrom b")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {(r.conv_id, r.turn): r for r in chat_format.format_chat(m).collect()}
    assert [got[1, t].position for t in range(300)] == list(range(300)) and {got[1, t].root_turn for t in range(300)} == {0}
    assert got[2, 0].position == 300 and sorted(got[2 + i, 1].position for i in range(1, 120)) == list(range(301, 420))
    assert all((got[2 + i, 1].root_conv, got[2 + i, 1].hops) == (2, 1) for i in range(1, 120))
    assert {(got[c, 0].root_conv, got[c, 0].root_turn) for c in (900, 901)} == {(900, 0)} and {got[900, 0].position, got[901, 0].position} == {420, 421}


def test_a_hot_line_of_a_hot_conversation(spark):
    """Quotes of one line in one conversation lie in several ranges, and find what earlier ranges hold."""
    rows = [(1, 0, "user", "old line"), *[(1, t, "user", "> old line\n" + ("old line" if t == 90 else f"answer {t}")) for t in range(1, 200)]]
    rows += [(2, t, "user", "> old line\n> none") for t in range(5)] + [(0, 3, "user", "> old line")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        links = {(r.conv_id, r.turn): (r.lines, r.linked, r.to_conv, r.to_turn) for r in chat_format.quote_links(m).collect()}
    finally:
        spark.conf.unset(key)
    assert links == {**{(1, t): (1, 1, 1, 0 if t <= 90 else 90) for t in range(1, 200)}, **{(2, t): (2, 1, 1, 0) for t in range(5)}, (0, 3): (1, 1, 1, 0)}


def test_chats_without_quotes(spark):
    got = {(r.conv_id, r.turn): r.text for r in queries.QUERIES["op3_chat_format"](spark, SF).collect()}
    assert got == {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}


def test_chats_oracle(spark):
    import duckdb

    sql = queries.ORACLE_SQL["op3_chat_format"]
    assert compare(queries.QUERIES["op3_chat_format"](spark, SF), duck(SF), sql) > 50
    rows = [list(r) for r in CHAT if r[0] is not None]
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    m = spark.createDataFrame([tuple(r) for r in rows], "conv_id long, turn long, role string, text string")
    assert compare(chat_format.format_chat(m), c, sql) == len(rows)


# cases that all operators share


EXTRA = "did id h key places w row quality good held_out firsts n start n_tokens score n_words kept class_id found text_ lo hi part size".split()


def operators():
    """Name and (docs, spark) -> DataFrame of every operator on documents."""
    from tidemark.llm import near_dedup, substring_dedup, suffix_dedup

    piece, bpe = queries.vocabulary("piece_bpe_32k.model"), queries.vocabulary("byte_bpe_50k.json")
    labels = lambda s: s.createDataFrame([(i, i % 2) for i in range(12)] + [(3, 0), (3, None), (None, 1)], "doc_id long, quality int")
    bench = lambda s: s.createDataFrame(ITEMS, "item_id int, text string")
    return {
        "op1": lambda d, s: sentencepiece_scan.encode(d, piece), "op2": lambda d, s: substring_dedup.substring_dedup(d), "op2 texts": lambda d, s: substring_dedup.without_repeats(d), "op4": lambda d, s: suffix_dedup.suffix_dedup(d),
        "op5": lambda d, s: quality_classifier.score_quality(d, labels(s)), "op5 texts": lambda d, s: quality_classifier.keep_good(d, labels(s)), "op6": lambda d, s: token_bins.token_digest(d, bpe), "op8": lambda d, s: decontaminate.score_contamination(d, bench(s)),
        "op8 texts": lambda d, s: decontaminate.decontaminate(d, bench(s), "both"), "op9": lambda d, s: near_dedup.near_dedup(d), "op9 texts": lambda d, s: near_dedup.one_of_each(d), "op10": lambda d, s: quality_rules.quality_rules(d),
    }


@pytest.mark.parametrize("name", sorted(operators()))
def test_other_columns_and_repeated_rows(spark, name):
    """Columns of the operators' own names, null and repeated ids, equal and conflicting rows change no result; columns stay as they are."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text + " end"), (3, None), (3, ""), (3, "other words"), (None, "a b"), (None, None), (4, "say: short-item here!")]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    wide = spark.createDataFrame([(*r, *[f"{c}{k}" for c in EXTRA]) for k, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA))
    run = operators()[name]
    a, b = run(plain, spark), run(wide, spark)
    key = lambda df: sorted((str([r[c] for c in a.columns]) for r in df.collect()))
    assert key(a) == key(b)
    if name.endswith("texts"):
        assert b.columns == wide.columns
        tags = {str((r.doc_id, r[EXTRA[0]])) for r in b.collect()}
        assert tags <= {str((i, f"{EXTRA[0]}{k}")) for k, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("name", sorted(operators()))
def test_one_very_long_text(spark, name):
    """A text of two million characters, a copy of it with another end, and one long word, beside short ones."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, long + " another end"), (3, "z" * 300_000), (4, "short one")], "doc_id long, text string")
    out = {r.doc_id: r for r in operators()[name](docs, spark).collect()}
    if name == "op9":
        assert {k: r.class_id for k, r in out.items()} == {1: 1, 2: 1, 3: 3, 4: 4}
    elif name == "op2":
        assert {k: r.n_removed for k, r in out.items()} == {1: 0, 2: 300_000, 3: 0, 4: 0}
    elif name == "op4":
        assert {k: r.n_removed for k, r in out.items()} == {1: len(long), 2: len(long), 3: 300_000, 4: 0}
    elif name == "op1":
        assert all(r.round_trip for r in out.values()) and out[1].n_chunks > 100
    else:
        assert len(out) > 0


def test_conflicting_labels(spark):
    """Half of an id's labels or more being 1 makes it good; a label of several texts of one id counts for all of them."""
    good, bad = "a fine long sentence about the sea and the wind", "$$$ ### !!! ||| $$$ ###"
    ids = [i for i in range(200) if __import__("zlib").crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"{good if i % 2 else bad} {i}") for i in ids] + [(ids[0], good)], "doc_id long, text string")
    labels = spark.createDataFrame([x for i in ids for x in ([(i, 1), (i, 0)] if i % 2 else [(i, 0), (i, 0), (i, 1)])], "doc_id long, quality int")
    got = quality_classifier.score_quality(docs, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id != ids[0])
